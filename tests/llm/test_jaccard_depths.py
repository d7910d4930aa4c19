import random

from termloom.llm import jaccard


def test_loose_pairs_are_found_beside_a_large_group(docs):
    r = random.Random(3)
    text = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    base, rows = text(200), []
    for i in range(300):
        copy = list(base)
        copy[r.randrange(190)] = f"x{i}"
        rows.append((i, " ".join(copy), "en"))
    for i in range(60):
        one = text(200)
        rows += [(1000 + 2 * i, " ".join(one), "en"), (1001 + 2 * i, " ".join(one[:140] + text(60)), "en")]
    got = {(x.doc_id, x.duplicate_of) for x in jaccard.near_duplicates(docs(*rows)).collect()}
    assert sum((1001 + 2 * i, 1000 + 2 * i) in got for i in range(60)) >= 57
