import random

import pytest

from termloom.functions import text as t
from termloom.operators import linking, segment
from termloom.plans import queries

SPANS = ("phrase_longest_match", "link_spans_greedy", "multilink_merge", "first_occurrence", "self_link_filter", "domain_filter", "html_links")
CLASSES = ("eligible_candidates", "category_weights", "category_ranking", "disambiguate")
TEXTS = ("annotate_html", "annotate_rdfa", "standoff_spans", "standoff_merged_json", "standoff_json")
EDGES = ("links_cache_build", "links_cache_flush", "links_of_concept", "invalidate_urls", "merge_snapshot_links")
WORDS = ["torsion", "modules", "Module's", "Noetherian", "algebraic", "geometry", "the", "Über", "überring", "ring's", "category", "functors", "spectral", "sequences", "and", "x"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path, r = tmp_path_factory.mktemp("linked"), random.Random(8)
    text = lambda n: "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "\n", ", ", ". ", "  ", " -"]) for _ in range(n))
    items = [(k, text(30)) for k in range(1, 9)]
    docs = [(k, text(r.randint(0, 60)), r.choice(["en", "de"])) for k in range(1, 41)]
    docs += [docs[3], docs[3], (5, text(40), "en"), (5, None, "en"), (None, text(40), "de"), (None, text(40), "de"), (90, "", "en"), (91, None, "de"), (92, " -- 𝒳 torsion módules", "en")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    pages = [(k, f"http://p.org/{k}", f"<p>{text(20)}<b>{text(5)}</b><a>{text(5)}</a></p>") for k in range(5)]
    spark.createDataFrame([*pages, pages[0]], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.fixture(scope="module")
def plain(spark, tables, tmp_path_factory):
    """Without repeated ids."""
    path = str(tmp_path_factory.mktemp("plain"))
    for name, key in (("documents", "doc_id"), ("pages", "page_id"), ("benchmark", "item_id")):
        spark.read.parquet(f"{tables}/{name}.parquet").dropDuplicates([key]).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", [*SPANS, *CLASSES, *TEXTS, *EDGES])
def test_rows_are_those_of_joins(spark, tables, name, monkeypatch):
    rows = lambda: sorted(map(repr, queries.QUERIES[name](spark, tables).collect()))
    got = rows()
    monkeypatch.setattr(linking, "LEXICON_BYTES", -1)
    assert got and got == rows()


@pytest.mark.parametrize("name", [*SPANS, *CLASSES, *TEXTS])
def test_neither_texts_nor_matches_are_shuffled(spark, plain, name):
    plan = queries.QUERIES[name](spark, plain)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning(doc_id" not in plan and "hashpartitioning(key" not in plan


@pytest.mark.parametrize("name", EDGES)
def test_edges_are_not_sorted(spark, plain, name):
    plan = queries.QUERIES[name](spark, plain)._jdf.queryExecution().executedPlan().toString()
    sides = plan.split("SortMergeJoin")[1:]
    assert not any("MapInArrow" in s for s in sides)


def test_words_and_normal_forms_are_those_of_columns(spark):
    r = random.Random(1)
    texts = ["".join(r.choices([*"aeisxyscheo'+-_ \n.ßéÀİΣςжя́ø½²𝒳中\x0b", "ies", "rices", "tices", "'s ", "oci ", "ses "], k=r.randint(0, 60))) for _ in range(500)]
    want = segment.words(segment.text_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).select("doc_id", "offset_begin", "offset_end", "word", t.normal_word(queries.F.col("word")).alias("n")).collect()
    got = linking.Tokens(linking.pa.array([None, "é-", *texts]).slice(2))
    assert sorted(zip(got.row.tolist(), got.begin.tolist(), got.end.tolist(), got.word.to_pylist())) == sorted((x.doc_id, x.offset_begin, x.offset_end, x.word) for x in want)
    assert [x.word for x in want if x.n != linking.normal_word(x.word)] == []
