from pyspark.sql import functions as F

from termloom.api import LinkOptions, find_matches, index_pages, link_documents
from termloom.functions.classes import CODES, log_matrix, matrix, stop_words, with_similarity
from termloom.operators import annotate, classify, discover, harvest, kb, segment
from termloom.sources import extractors

CONCEPT = "conceptid long, firstword string, tailwords string, category string, scheme string, domain string, link string, objectid long"


def concepts(spark, *rows):
    return spark.createDataFrame(list(rows), CONCEPT)


BANACH = (1, "banach", "algebra", "46H05", "msc", "Here", "here.org/banachalgebra", 1)


def test_longest_phrase_with_offsets(spark):
    text = "Banach, algebra and banach. algebra or Banach-algebra. We want to get Banach's Algebra linked"
    docs = spark.createDataFrame([(7, text), (8, ""), (9, None)], "doc_id long, text string")
    found = discover.discover(segment.text_runs(docs), concepts(spark, BANACH)).collect()
    assert [(r.doc_id, text[r.offset_begin : r.offset_end]) for r in found] == [(7, "Banach's Algebra")]


def test_greedy_takes_the_left_one(spark):
    rows = [(1, "group", "theory", "20-XX", "msc", "a", "l1", 1), (2, "theory", "of everything", "20-XX", "msc", "a", "l2", 1), (3, "group", "", "20-XX", "msc", "a", "l3", 1)]
    docs = spark.createDataFrame([(1, "group theory of everything, group")], "doc_id long, text string")
    found = discover.discover(segment.text_runs(docs), concepts(spark, *rows)).orderBy("offset_begin").collect()
    assert [(r.offset_begin, r.conceptid) for r in found] == [(0, 1), (28, 3)]


def test_html_skips_elements(spark):
    html = "<html><head><title>t</title></head><p>one <a href='x'>two</a> <span class=\"nolink\">three <b>four</b></span> five<!-- six --><h1>seven</h1><span>eight</span></p></html>"
    pages = spark.createDataFrame([(1, html)], "doc_id long, html string")
    got = segment.html_runs(pages).orderBy("offset").collect()
    assert [r.text.strip() for r in got] == ["one", "five", "eight"]
    assert all(html[r.offset :].startswith(r.text) for r in got)


def test_similarity(spark):
    m, logs = matrix(), log_matrix()
    assert len(CODES) == 63 and len(stop_words()) == 676
    assert all(m[i][j] == m[j][i] for i in range(63) for j in range(63)) and all(m[i][i] == 1 for i in range(63))
    assert abs(min(map(min, logs)) + 12.501985524931895) < 1e-12
    pairs = spark.createDataFrame([(None, None), (None, "00-XX"), ("00-XX", None), ("00-XX", "00-XX"), ("00-XX", "XX-XX")], "a string, b string")
    assert sorted(r.sim for r in with_similarity(pairs, "a", "b").collect()) == [0, 0, 0, 0, 1]


def test_disambiguation_keeps_the_best_class(spark):
    rows = [("fake scheme", "fake", "random", None), ("missing category", "msc", "XX-XX", None), ("A", "msc", "00-XX", "x/A"), ("group", "msc", "00-XX", "x/group"), ("banach algebra", "msc", "46H05", "x/banach")]
    cols = "doc_id long, offset_begin int, offset_end int, conceptid long, concept string, scheme string, category string, link string"
    df = spark.createDataFrame([(1, i, i + 1, i, c, s, k, l) for i, (c, s, k, l) in enumerate(rows)], cols)
    assert [(r.concept, r.category) for r in classify.disambiguate(df).collect()] == [("banach algebra", "46H05")]
    assert classify.disambiguate(df, include_all=True).count() == 5


def test_clique_search():
    logs = log_matrix()
    assert classify.best_clique([], logs) == []
    assert classify.best_clique([(0, 5.0, 1)], logs) == [0]
    assert classify.best_clique([(0, 0.0, 1), (1, 0.0, 1)], logs) == []  # a clique of score 0 isn't a result
    assert classify.best_clique([(0, 30.0, 1), (1, 30.0, 1)], logs) == [0, 1]


BODY = "Simple. We want Banach's algebra linked, also Abelian groups."


def annotated(spark, **k):
    cols = "doc_id long, offset_begin int, offset_end int, conceptid long, concept string, category string, scheme string, domain string, link string, multilinks array<string>"
    rows = [
        (1, 16, 32, 1, "Banach's algebra", "c", "msc", "P", "p.org/b", None),
        (1, 46, 60, 2, "Abelian groups", "c", "msc", "M", "m.org/a", None),
        (1, 46, 60, 3, "Abelian groups", "c", "msc", "P", None, ["p.org/a", "p.org/g"]),
    ]
    docs = spark.createDataFrame([(1, BODY), (2, "none")], "doc_id long, text string")
    out = annotate.embed(docs, spark.createDataFrame(rows, cols), icons={"P": "i.ico"}, **k)
    return {r.doc_id: (r.annotated, r.n_links) for r in out.collect()}


def test_annotation(spark):
    got = annotated(spark)
    menu = [f'<a class="concept" href="http://{u}"><img src="{i}" alt="{d}"></img></a>' for u, i, d in (("p.org/a", "i.ico", "P"), ("p.org/g", "i.ico", "P"), ("m.org/a", "", "M"))]
    head = f'<a class="concepts" href="{annotate.NOWHERE}" onclick="{annotate.SHOW}">'
    assert got[1] == (f'Simple. We want <a class="concept" href="http://p.org/b">Banach\'s algebra</a> linked, also {head}Abelian groups</a><sup style="{annotate.HIDDEN}">{"".join(menu)}</sup>.', 4)
    assert got[2] == ("none", 0)
    assert 'property="http://purl.org/dc/terms/relation" href="http://p.org/b"' in annotated(spark, annotation="HTML+RDFa")[1][0]
    assert annotated(spark, annotation="xml")[1][0] == BODY
    assert annotated(spark, domain="M")[1][1] == 1


def test_harvest_and_differences(spark):
    h = spark.createDataFrame([("p", "integrations", "u", None, ["11-XX", "00-XX"], ["the integral", "Summation"])], "page string, concept string, url string, scheme string, categories array<string>, synonyms array<string>")
    flat = harvest.flatten(h)
    assert [(r.concept, r.category) for r in flat.collect()] == [(c, k) for c in ("integral", "summation", "integration") for k in ("11-XX", "00-XX")]
    old = spark.createDataFrame([("integration", "00-XX"), ("deleteme", "11-XX")], "concept string, category string")
    assert [r.concept for r in harvest.to_delete(old, flat).collect()] == ["deleteme"]
    assert harvest.to_add(old, flat).count() == 5 and harvest.unchanged(old, flat).count() == 1


def page(url, title):
    return (url, f'<html>\n<head>\n<meta name="DC.Title" content="{title}" />\n<meta name="DC.Subject" scheme="MSC_2000" content="15A72" />\n</head></html>')


def test_index_and_invalidate(spark, tmp_path):
    pages = lambda *p: spark.createDataFrame(list(p), "url string, html string")
    url = "http://mathworld.wolfram.com/X.html"
    base, urls = index_pages(pages(page(url, "Quadratic Invariant")), kb.KnowledgeBase.empty(spark), "mathworld")
    got = base.concepts.collect()
    assert [(r.firstword, r.tailwords, r.category, r.domain, r.link) for r in got] == [("quadratic", "invariant", "15A72", "Mathworld", "mathworld.wolfram.com/X.html")] and urls.count() == 0
    base.write(str(tmp_path / "kb"))
    base = kb.KnowledgeBase.read(spark, str(tmp_path / "kb"))
    objects = kb.add_objects(base, spark.createDataFrame([("o2", "d"), ("o2", "d"), (None, "d")], "url string, domain string"))
    o2 = kb.object_by(objects, url="o2").first().objectid
    linked = kb.relink(objects, spark.createDataFrame([(o2, got[0].conceptid)], "objectid long, conceptid long"), spark.createDataFrame([(o2,)], "objectid long"))
    same, urls = index_pages(pages(page(url, "Quadratic Invariant")), linked, "mathworld")
    assert urls.count() == 0 and same.concepts.first().conceptid == got[0].conceptid
    changed, urls = index_pages(pages(page(url, "Cubic Invariant")), linked, "mathworld")
    assert [r.url for r in urls.collect()] == ["o2"]
    assert [r.firstword for r in changed.concepts.collect()] == ["cubic"] and changed.links.count() == 0


def test_merge(spark):
    one = kb.KnowledgeBase(spark.createDataFrame([(5, "a", "d", None)], kb.OBJECTS), concepts(spark, (9, "x", "", "c", "msc", "d", "a", 5)), spark.createDataFrame([(5, 9)], kb.LINKS))
    m = kb.merge([one, one])
    assert sorted(r.objectid for r in m.objects.collect()) == [1, 2]
    assert sorted((r.conceptid, r.objectid) for r in m.concepts.collect()) == [(1, 1), (2, 2)] == sorted((r.conceptid, r.objectid) for r in m.links.collect())


def test_extractors(spark):
    html = {
        "Planetmath": ("planetmath.org/x", '<div property="dct:title" content="Ring"></div><section class="ltx_document"><div property="pm:defines" content="pmconcept:unit"></div><div property="dct:subject" resource="msc:13A99"></div></section>', [("unit", ["13A99"]), ("Ring", ["13A99"])]),
        "Wikipedia": ("en.wikipedia.org/wiki/Group", '<span dir="auto">Group (mathematics)</span><p>A <b>group object</b></p>', [("group", ["XX-XX"])]),
        "Nlab": ("http://ncatlab.org/nlab/show/group", '<h1>Group</h1><a class="category_link" href="/c">algebra</a>', [("group", ["algebra"])]),
        "Encyclopediaofmath": ("eom", '<table class="mw-allpages-table-chunk"><a href="/index.php/Ring" title="Ring">Ring</a></table>', [("Ring", ["XX-XX"])]),
        "Mathhub": ("x/a.en.omdoc", '<span class="definiendum" jobad:href="u1">set</span><span class="definiendum" jobad:href="u2">set</span>', [("set", ["XX-XX"])]),
        "Mathoverflow": ("m", 'x "ag.algebraic-geometry" "nt.number-theory" y', [("algebraic geometry", ["XX-XX"]), ("number theory", ["XX-XX"])]),
        "Dlmf": ("http://dlmf.nist.gov/idx/Z", '<li><span>zonal polynomials: <span class="ltx_text ltx_font_bold"><a href="./35.4">35.4</a></span></span></li>', [("zonal polynomials", ["33-XX"])]),
        "unknown": ("u", "<h1>x</h1>", []),
    }
    for domain, (url, text, want) in html.items():
        got = extractors.harvest(spark.createDataFrame([(url, text)], "url string, html string"), domain).collect()
        assert [(r.concept, r.categories) for r in got] == want, domain


def test_link_documents(spark):
    base = kb.KnowledgeBase(spark.createDataFrame([], kb.OBJECTS), concepts(spark, BANACH), spark.createDataFrame([], kb.LINKS))
    docs = spark.createDataFrame([(1, "<p>A banach algebra</p>", "x.org"), (2, "<p>Banach algebras</p>", "http://here.org/banachalgebra")], "doc_id long, text string, url string")
    out = {r.doc_id: r.annotated for r in link_documents(docs, base).collect()}
    assert out == {1: '<p>A <a class="concept" href="http://here.org/banachalgebra">banach algebra</a></p>', 2: "<p>Banach algebras</p>"}
    assert [r.payload for r in link_documents(docs, base, LinkOptions(embed=False, annotation="json")).collect()][0].startswith('[{"offset_begin":5')
    assert find_matches(docs, base, LinkOptions(format="pdf"))[0].count() == 0
