from termloom.api import LinkOptions, default_base, index_domain, index_pages, link_and_record
from termloom.operators import kb
from termloom.sources import extractors
from termloom.streaming.reindex import reindex_stream


def page(title, subject="15A72"):
    return f'<html>\n<head>\n<meta name="DC.Title" content="{title}" />\n<meta name="DC.Subject" scheme="MSC_2000" content="{subject}" />\n</head></html>'


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, html string")


URL = "http://mathworld.wolfram.com/X.html"


def test_linking_is_recorded_and_changes_reach_it(spark):
    base, _ = index_pages(pages(spark, (URL, page("Quadratic Invariant"))), kb.KnowledgeBase.empty(spark), "mathworld")
    docs = spark.createDataFrame([(1, "<p>a quadratic invariant</p>", "http://www.blog.org/1"), (2, "<p>nothing</p>", "blog.org/2"), (3, "<p>quadratic invariant</p>", None)], "doc_id long, text string, url string")
    out, linked = link_and_record(docs, base, "Blog", LinkOptions(include_all=True))
    assert sum(r.n_links for r in out.collect()) == 2 and linked.links.count() == 1
    o1 = kb.object_by(linked, url="blog.org/1").first().objectid
    concept = linked.concepts.first().conceptid
    assert [r.conceptid for r in kb.adjacent(linked, objectid=o1).collect()] == [concept] and [r.objectid for r in kb.adjacent(linked, conceptid=concept).collect()] == [o1]
    assert kb.adjacent(linked).count() == 0
    # three revisions: unchanged, changed, changed back after linking again
    same, urls = index_pages(pages(spark, (URL, page("Quadratic Invariant"))), linked, "mathworld")
    assert urls.count() == 0
    changed, urls = index_pages(pages(spark, (URL, page("Cubic Invariant"))), same, "mathworld")
    assert [r.url for r in urls.collect()] == ["blog.org/1"]
    again = docs.replace({"<p>nothing</p>": "<p>cubic invariant</p>"}, subset=["text"])
    _, relinked = link_and_record(again, changed, "Blog", LinkOptions(include_all=True))
    assert relinked.objects.count() == linked.objects.count()
    _, urls = index_pages(pages(spark, (URL, page("Quadratic Invariant"))), relinked, "mathworld")
    assert [r.url for r in urls.collect()] == ["blog.org/2"]


def test_forms_of_an_address_are_one_page(spark):
    rows = pages(spark, (URL, page("Old")), (URL.replace("http", "https"), page("Some Form")), (None, page("x")), ("", page("y")))
    base, _ = index_pages(rows, kb.KnowledgeBase.empty(spark), "mathworld")
    assert [(r.firstword, r.tailwords) for r in base.concepts.collect()] == [("some", "form")] and base.objects.count() == 1
    kept, urls = index_pages(pages(spark, (URL, page("Other"))), base, "mathworld", update=False)
    assert [r.firstword for r in kept.concepts.collect()] == ["some"] and urls.count() == 0


def test_domain_is_walked_with_its_categories(spark):
    wiki = "http://en.wikipedia.org/wiki/"
    listing = lambda subs, own: f'<div id="mw-subcategories">{"".join(f"""<a href="/wiki/Category:{s}">""" for s in subs)}</div><div id="mw-pages">{"".join(f"""<a href="/wiki/{o}">""" for o in own)}</div>'
    blocked = extractors.blocked_categories(spark).first().name
    rows = [
        (wiki + "Category:Top", listing(["Sub", blocked], ["Ring"])), (wiki + "Category:Sub", listing([], ["Ring", "Group"])), (wiki + "Category:" + blocked, listing([], ["Away"])),
        *[(wiki + n, f'<span dir="auto">{n} (mathematics)</span><p>x</p>') for n in ("Ring", "Group", "Away", "Alone")],
    ]
    start = spark.createDataFrame([(wiki + "Category:Top",)], "url string")
    base, _ = index_domain(pages(spark, *rows), kb.KnowledgeBase.empty(spark), "Wikipedia", start)
    assert sorted((r.firstword, r.category) for r in base.concepts.collect()) == [("group", "Sub"), ("ring", "Sub"), ("ring", "Top")]
    free, _ = index_domain(pages(spark, *rows), kb.KnowledgeBase.empty(spark), "Wikipedia", start, blocked=False)
    assert "away" in {r.firstword for r in free.concepts.collect()}


def test_links_of_sites(spark):
    html = {
        "Planetmath": ("planetmath.org/articles", '<div class="view-content"><a href="/ring">r</a><a href="/a/b">x</a></div>', ["http://planetmath.org/ring"]),
        "Dlmf": ("http://dlmf.nist.gov/idx", '<a href="./idx/A">A</a><a href="./35.4">x</a>', ["http://dlmf.nist.gov/idx/A"]),
        "Nlab": ("http://ncatlab.org/nlab/search?query=", '<ul><li><a href="/nlab/show/a+b">x</a></li></ul>', ["http://ncatlab.org/nlab/show/a+b"]),
        "Encyclopediaofmath": ("e", '<table class="allpageslist"><a href="/index.php/A">A</a></table>', ["http://www.encyclopediaofmath.org/index.php/A"]),
        "Mathhub": ("http://mathhub.info/archives", '<li><a href="/x">x</a></li>', ["http://mathhub.info/x/source"]),
        "Mathworld": ("http://mathworld.wolfram.com", '<table id="directory"><a href="/topics/A.html">A</a></table>', ["http://mathworld.wolfram.com/topics/A.html"]),
        "Mathoverflow": ("m", '<a href="/x">x</a>', []),
    }
    for domain, (url, text, want) in html.items():
        assert [r.target for r in extractors.links(pages(spark, (url, text)), domain).collect()] == want, domain


def test_stream_batches_are_written_once(spark, tmp_path):
    at, seen = str(tmp_path / "kb"), []
    default_base(spark, at)
    pages(spark, (URL, page("First Form"))).write.parquet(str(tmp_path / "in"))
    run = lambda c: reindex_stream(spark.readStream.schema("url string, html string").parquet(str(tmp_path / "in")), at, "mathworld", str(tmp_path / c), lambda u, n: seen.append(n)).awaitTermination()
    run("c1")
    assert [r.firstword for r in kb.KnowledgeBase.read(spark, at).concepts.collect()] == ["first"] and seen == [0]
    run("c2")  # the same batch again, as after a lost checkpoint
    assert seen == [0] and kb.KnowledgeBase.read(spark, at).concepts.count() == 1


def test_ids_are_dense_over_many_ranges(spark):
    rows = spark.range(1000).selectExpr("concat('u', id) AS url", "'d' AS domain").repartition(7)
    got = kb.add_objects(kb.KnowledgeBase.empty(spark), rows).objects.orderBy("objectid").collect()
    assert [r.objectid for r in got] == list(range(1, 1001)) and [r.url for r in got] == sorted(r.url for r in got)
