import random
import re
import time

from pyspark.sql import functions as F

from termloom.functions.classes import log_matrix
from termloom.operators import annotate, classify, discover, segment

CONCEPT = "conceptid long, firstword string, tailwords string, category string, scheme string, domain string, link string, objectid long"
RING = (1, "ring", "", "13-XX", "msc", "d", "l", 1)


def words(spark, *rows):
    docs = spark.createDataFrame(list(rows), "doc_id long, text string")
    return sorted((r.doc_id or 0, r.offset_begin, r.offset_end, r.word) for r in segment.words(segment.text_runs(docs)).collect())


def test_rows_of_one_doc_id_stay_apart(spark):
    assert words(spark, (1, "alpha beta"), (1, "gamma beta")) == [(1, 0, 5, "alpha"), (1, 0, 5, "gamma"), (1, 6, 10, "beta"), (1, 6, 10, "beta")]
    assert words(spark, (None, "a b"), (None, "cc"), (2, None), (3, ""), (4, "..")) == [(0, 0, 1, "a"), (0, 0, 2, "cc"), (0, 2, 3, "b")]


def test_repeated_rows_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a ring"), (1, "a ring"), (1, "no ring at all, ring"), (None, "ring")], "doc_id long, text string")
    found = discover.with_concepts(discover.greedy(discover.spans(segment.text_runs(docs), spark.createDataFrame([RING], CONCEPT))), discover.merged(spark.createDataFrame([RING], CONCEPT)))
    assert sorted((r.doc_id or 0, r.offset_begin) for r in found.collect()) == [(0, 0), (1, 2), (1, 3), (1, 16)]
    out = annotate.embed(docs, found)
    assert sorted(r.annotated.count("href") for r in out.collect()) == [1, 1, 1, 2]


def test_words_against_a_plain_scan(spark):
    r = random.Random(4)
    texts = ["".join(r.choices("aé1_ -'+.\n", k=r.randint(0, 400))) for _ in range(60)]
    want = sorted((i, m.start(), m.end(), m.group()) for i, x in enumerate(texts) for m in re.finditer(r"\w[\w+'-]*", x))
    assert words(spark, *enumerate(texts)) == sorted((i or 0, a, b, w) for i, a, b, w in want)


def test_no_exchange_before_matches_are_gathered(spark):
    docs = spark.createDataFrame([(1, "a ring")], "doc_id long, text string")
    plan = discover.greedy(discover.spans(segment.text_runs(docs), spark.createDataFrame([RING], CONCEPT)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.index("ObjectHashAggregate") < plan.index("Exchange hashpartitioning(doc_id")


def test_time_grows_with_text(spark):
    concepts = spark.createDataFrame([RING], CONCEPT)

    def took(n):
        docs = spark.createDataFrame([(1, "ring of " * n)], "doc_id long, text string")
        began = time.time()
        m = discover.with_concepts(discover.greedy(discover.spans(segment.text_runs(docs), concepts)), discover.merged(concepts))
        assert annotate.embed(docs, m).first().n_links == n
        return time.time() - began

    took(10)
    assert took(40_000) < 4 * max(took(20_000), 1)


def test_nested_nolink_spans(spark):
    html = '<span class="nolink">a<span class="nolink">b</span>c</span>d<span>e</span>'
    got = segment.html_runs(spark.createDataFrame([(1, html), (2, None), (3, "")], "doc_id long, html string")).collect()
    assert sorted(r.text for r in got) == ["d", "e"]
    assert segment.text_length(spark.createDataFrame([(1, html), (1, html), (2, None)], "doc_id long, html string")).collect()[0].text_length == 2


def cliques(queue, logs):
    """All cliques that the rules allow, by plain recursion without pruning: (score, members) in order of search."""
    out = []

    def go(at, score, clique):
        if at == len(queue) or score:
            out.append((score if at == len(queue) or score else 0, clique))
        bound = 0
        for k in range(at, len(queue)):
            own, weight, size = queue[k]
            if size < bound:
                return
            terms = [logs[own][c] for c in clique]
            if all(terms) and weight + sum(terms) >= 0:
                go(k + 1, score + weight + sum(terms), [*clique, own])
                bound = size

    go(0, 0.0, [])
    return out


def test_best_clique_against_all_cliques():
    r, logs = random.Random(7), log_matrix()
    for _ in range(300):
        queue = [(c, float(r.randint(0, 40)), r.randint(1, 3)) for c in r.sample(range(63), r.randint(0, 7))]
        best = max((s for s, _ in cliques(queue, logs)), default=0)
        got = classify.best_clique(queue, logs)
        assert (got in [c for s, c in cliques(queue, logs) if abs(s - best) < 1e-9]) if best else got == []


def test_matches_come_in_order_of_offset(spark):
    cols = "doc_id long, offset_begin int, offset_end int, conceptid long, concept string, scheme string, category string, link string"
    rows = [(1, 9 - i, 10 - i, i, "long concept", "msc", "46H05", f"l{i}") for i in range(9)]
    assert [x.offset_begin for x in classify.disambiguate(spark.createDataFrame(rows, cols)).collect()] == list(range(1, 10))


def test_parent_folders_of_urls(spark):
    from termloom.functions.text import canonical_url

    urls = ["http://www.a.org/" + "x/" * n + "../" * n + "y" for n in (1, 9, 20)] + ["https://a.org/./b/../c", "a.org"]
    got = [r.u for r in spark.createDataFrame([(u,) for u in urls], "u string").select(canonical_url(F.col("u")).alias("u")).collect()]
    assert got == ["a.org/y", "a.org/y", "a.org/y", "a.org/c", "a.org"]
