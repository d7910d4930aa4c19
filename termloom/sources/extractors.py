"""Harvesting rules of web sites: columns of a page's concepts and links, chosen by domain name.

Rules read HTML by patterns, inside whole-stage plans; attribute order as the sites write it. A page is (url, html, and
categories array<string> handed down by the page that led to it, may be null).
"""

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as t
from termloom.functions.classes import RESOURCES

HARVEST = "array<struct<concept:string,url:string,scheme:string,categories:array<string>,synonyms:array<string>>>"
NONE = ["XX-XX"]


def every(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(f"(?s){pattern}"), F.lit(group))


def first(html: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(html, f"(?s){pattern}", 1), F.lit(""))


def plain_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "<[^>]*>", ""))


def row(concept: Column, url: Column, scheme: Column | None = None, categories: Column | None = None, synonyms: Column | None = None) -> Column:
    empty = F.lit(None).cast("array<string>")
    return F.struct(
        concept.alias("concept"), url.alias("url"), (F.lit(None).cast("string") if scheme is None else scheme).alias("scheme"),
        (F.array(*map(F.lit, NONE)) if categories is None else categories).alias("categories"), (empty if synonyms is None else synonyms).alias("synonyms"),
    )


def or_none(categories: Column) -> Column:
    return F.when(F.size(F.coalesce(categories, F.array().cast("array<string>"))) > 0, categories).otherwise(F.array(*map(F.lit, NONE)))


@dataclass(frozen=True)
class Extractor:
    concepts: Callable[[Column, Column, Column], Column]  # (url, html, categories) -> HARVEST
    links: Callable[[Column, Column], Column]  # (url, html) -> array<string>
    depth: int = 4
    interval: float = 2.0  # seconds between requests, for whoever fetches pages
    category: Callable[[Column], Column] | None = None  # of a page, handed down to the pages it links


def _nothing(*_: Column) -> Column:
    return F.array().cast(HARVEST)


def _no_links(*_: Column) -> Column:
    return F.array().cast("array<string>")


def _planetmath(url: Column, html: Column, _: Column) -> Column:
    content = lambda p: every(html, rf'<div[^>]*property="{p}"[^>]*content="([^"]*)"')
    title = first(html, r'<div[^>]*property="dct:title"[^>]*content="([^"]*)"')
    subjects = F.transform(every(html, r'<div[^>]*property="dct:subject"[^>]*resource="([^"]*)"'), lambda s: t.without_prefix(s, "msc"))
    cats = or_none(F.filter(subjects, lambda s: s != ""))
    defined = F.transform(content("pm:defines"), lambda c: row(t.without_prefix(c, "pmconcept"), url, None, cats))
    rows = F.concat(defined, F.array(row(title, url, None, cats, content("pm:synonym"))))
    leaf = ~url.rlike("/articles") & title.isNotNull() & html.rlike('<section[^>]*class="ltx_document"')
    return F.when(leaf, rows.cast(HARVEST)).otherwise(_nothing())


def _planetmath_links(_: Column, html: Column) -> Column:
    view = F.regexp_extract(html, r'(?s)<div class="view-content">(.*?)</div>', 1)
    pages = F.filter(every(view, r'<a[^>]*href="([^"]*)"'), lambda h: h.rlike(r"^/\w+$"))
    lists = every(html, r'<div class="item-list">(.*?)</div>')
    nav = F.filter(every(F.coalesce(F.get(lists, F.lit(1)), F.lit("")), r'<a[^>]*href="([^"]*)"'), lambda h: h.rlike(r"^/articles\?section=All"))
    return F.transform(F.concat(nav, pages), lambda h: F.concat(F.lit("http://planetmath.org"), h))


_CATEGORY = r"/wiki/Category:(.+)$"


def _wikipedia(url: Column, html: Column, categories: Column) -> Column:
    name = t.page_concept(plain_text(F.coalesce(first(html, r'<span dir="auto">(.*?)</span>'), F.lit(""))))
    bold = F.transform(every(F.regexp_extract(html, r"(?s)<p>(.*?)</p>", 1), r"<b>(.*?)</b>"), lambda b: F.lower(plain_text(b)))
    synonyms = F.filter(bold, lambda b: (F.length(b) > 4) & (b != name))
    return F.when(~url.rlike(_CATEGORY) & (name != ""), F.array(row(name, url, F.lit("wiki"), or_none(categories), synonyms)).cast(HARVEST)).otherwise(_nothing())


def _wikipedia_links(url: Column, html: Column) -> Column:
    section = lambda i: F.regexp_extract(html, rf'(?s)<div id="{i}">(.*?)(?:<div id="|$)', 1)
    subs = F.filter(every(section("mw-subcategories"), r'<a[^>]*href="([^"]*)"'), lambda h: h.rlike(r"^/wiki/Category:"))
    own = F.filter(every(section("mw-pages"), r'<a[^>]*href="([^"]*)"'), lambda h: h.rlike(r"^/wiki/[^/:]+$"))
    links = F.transform(F.concat(subs, own), lambda h: F.concat(F.lit("http://en.wikipedia.org"), h))
    return F.when(url.rlike(_CATEGORY), links).otherwise(_no_links())


def _mathworld(url: Column, html: Column, _: Column) -> Column:
    head = F.regexp_extract(html, r"(?s)<head>(.*?)</head>", 1)
    name = first(head, r'<meta name="DC\.Title" content="([^"]*)"')
    cats = or_none(every(head, r'<meta[^>]*scheme="MSC_2000" content="([^"]*)"'))
    leaf = ~url.rlike(r"/(?:letters|topics)/")
    return F.when(leaf & name.isNotNull(), F.array(row(name, url, None, cats)).cast(HARVEST)).otherwise(_nothing())


def _mathworld_links(_: Column, html: Column) -> Column:
    area = F.regexp_extract(html, r'(?s)<[^>]*id="directory(?:six)?"[^>]*>(.*?)</(?:table|div|ul)>', 1)
    return F.transform(every(area, r'<a[^>]*href="([^"]*)"'), lambda h: F.concat(F.lit("http://mathworld.wolfram.com"), h))


_DLMF = "http://dlmf.nist.gov/"


def _dlmf(url: Column, html: Column, _: Column) -> Column:
    entry = r'<li[^>]*>\s*<span[^>]*>([^<]*)(?:<span class="ltx_text ltx_font_bold">.*?)</li>'
    names = F.transform(every(html, entry), lambda n: F.trim(t.cleaned_title(n)))
    hrefs = F.transform(every(html, r'<span class="ltx_text ltx_font_bold">\s*<a[^>]*href="([^"]*)"'), lambda h: t.absolute_link(h, _DLMF))
    notes = every(html, r'>([^<>]*)<a[^>]*class="ltx_ref"')
    note_names = F.transform(notes, lambda n: F.trim(F.split(n, ";")[0]))
    note_links = F.transform(every(html, r'<a[^>]*href="([^"]*)"[^>]*class="ltx_ref"'), lambda h: t.absolute_link(h, _DLMF, True))
    zipped = lambda a, b: F.filter(F.transform(F.arrays_zip(a.alias("n"), b.alias("l")), lambda x: row(x["n"], x["l"], None, F.array(F.lit("33-XX")))), lambda r: r["concept"].isNotNull() & r["url"].isNotNull())
    return F.when(url.rlike("/idx"), zipped(names, hrefs).cast(HARVEST)).when(url.rlike("/not"), zipped(note_names, note_links).cast(HARVEST)).otherwise(_nothing())


def _dlmf_links(_: Column, html: Column) -> Column:
    return F.transform(F.filter(every(html, r'<a[^>]*href="([^"]*)"'), lambda h: h.rlike(r"\./(?:idx|not)(?:/\w?)?$")), lambda h: t.absolute_link(h, _DLMF))


def _nlab(url: Column, html: Column, _: Column) -> Column:
    name = F.lower(plain_text(F.coalesce(first(html, r"<h1[^>]*>(.*?)</h1>"), F.lit(""))))
    cats = or_none(F.transform(every(html, r'<a class="category_link"[^>]*>(.*?)</a>'), plain_text))
    leaf = t.canonical_url(t.unescaped(url)).rlike(r"^ncatlab\.org/nlab/show/.+$")
    return F.when(leaf & (name != ""), F.array(row(name, t.unescaped(url), F.lit("nlab"), cats)).cast(HARVEST)).otherwise(_nothing())


def _nlab_links(url: Column, html: Column) -> Column:
    hrefs = every(F.regexp_extract(html, r"(?s)<ul[^>]*>(.*?)</ul>", 1), r'<a[^>]*href="([^"]*)"')
    links = F.array_distinct(F.transform(hrefs, lambda h: F.concat(F.lit("http://ncatlab.org"), t.unescaped(h))))
    return F.when(url.rlike(r"search\?query=$"), links).otherwise(_no_links())


_EOM = "http://www.encyclopediaofmath.org"


def _eom(_: Column, html: Column, __: Column) -> Column:
    table = F.regexp_extract(html, r'(?s)<table class="mw-allpages-table-chunk"[^>]*>(.*?)</table>', 1)
    both = F.arrays_zip(every(table, r'<a[^>]*href="([^"]*)"').alias("h"), every(table, r'<a[^>]*title="([^"]*)"').alias("n"))
    return F.transform(both, lambda x: row(x["n"], F.concat(F.lit(_EOM), t.unescaped(x["h"])))).cast(HARVEST)


def _eom_links(_: Column, html: Column) -> Column:
    table = F.regexp_extract(html, r'(?s)<table class="allpageslist"[^>]*>(.*?)</table>', 1)
    return F.array_distinct(F.transform(every(table, r'<a[^>]*href="([^"]*)"'), lambda h: F.concat(F.lit(_EOM), t.unescaped(h))))


def _mathhub(url: Column, html: Column, _: Column) -> Column:
    """Of a name's several addresses the last one counts; names in order of their first place."""
    span = r'<span[^>]*class="definiendum"[^>]*jobad:href="([^"]*)"[^>]*>(.*?)</span>'
    names, hrefs = F.transform(every(html, span, 2), plain_text), every(html, span, 1)
    last = lambda n: F.element_at(F.filter(F.arrays_zip(names.alias("n"), hrefs.alias("h")), lambda x: x["n"] == n), -1)["h"]
    rows = F.transform(F.filter(F.array_distinct(names), lambda n: n != ""), lambda n: row(n, last(n), F.lit("MSC")))
    return F.when(t.unescaped(url).rlike(r"\.en\.omdoc$"), rows.cast(HARVEST)).otherwise(_nothing())


def _mathhub_links(url: Column, html: Column) -> Column:
    refs = F.array_distinct(F.array_sort(every(html, r'<li class="dref">\s*<span[^>]*jobad:href="([^"]*)"')))
    leaves = F.filter(F.transform(refs, lambda h: t.source_path(t.unescaped(h))), lambda h: h.rlike(r"\.en\.omdoc$"))
    tops = F.array_distinct(F.array_sort(every(html, r'<li>\s*<a[^>]*href="([^"]*)"')))
    return F.when(url.rlike("/source$"), leaves).when(url.rlike("archives$"), F.transform(tops, lambda h: F.concat(F.lit("http://mathhub.info"), t.unescaped(h), F.lit("/source")))).otherwise(_no_links())


def _mathoverflow(_: Column, html: Column, __: Column) -> Column:
    tags = F.split(F.regexp_replace(F.regexp_replace(plain_text(html), r'^[^"]+"|^"', ""), r'"[^"]*$', ""), r'" "')
    return F.transform(tags, lambda g: row(t.tag_to_concept(g), F.concat(F.lit("http://mathoverflow.net/tags/"), g, F.lit("/info")))).cast(HARVEST)


REGISTRY: dict[str, Extractor] = {
    "Planetmath": Extractor(_planetmath, _planetmath_links, 10_000, 0.5),
    "Wikipedia": Extractor(_wikipedia, _wikipedia_links, 20, category=lambda u: F.nullif(F.regexp_extract(u, _CATEGORY, 1), F.lit(""))),
    "Mathworld": Extractor(_mathworld, _mathworld_links, 10, 12.0),
    "Dlmf": Extractor(_dlmf, _dlmf_links, 100),
    "Nlab": Extractor(_nlab, _nlab_links),
    "Encyclopediaofmath": Extractor(_eom, _eom_links),
    "Mathhub": Extractor(_mathhub, _mathhub_links, interval=1.0),
    "Mathoverflow": Extractor(_mathoverflow, _no_links, interval=1.0),
}
GENERIC = Extractor(_nothing, _no_links)


def extractor(domain: str) -> Extractor:
    """By name in any case; unknown names get the generic one, which harvests nothing."""
    return REGISTRY.get(domain[:1].upper() + domain[1:].lower(), GENERIC)


def harvest(pages: DataFrame, domain: str) -> DataFrame:
    """pages (url, html[, categories]) as (page, concept, url, scheme, categories, synonyms)."""
    cats = F.col("categories") if "categories" in pages.columns else F.lit(None).cast("array<string>")
    x = F.explode(extractor(domain).concepts(F.col("url"), F.col("html"), cats))
    out = pages.select(t.canonical_url(F.col("url")).alias("page"), x.alias("x")).select("page", "x.*")
    return out.withColumn("url", t.canonical_url(F.col("url")))


def blocked_categories(spark: SparkSession) -> DataFrame:
    """(name) of the categories that lead away from the subject."""
    names = pq.read_table(RESOURCES / "category_blacklist.parquet").column(0).to_pylist()
    return spark.createDataFrame([(n,) for n in names], "name string")


def links(pages: DataFrame, domain: str) -> DataFrame:
    """(url, target) of the pages to be visited next."""
    return pages.select("url", F.explode(F.array_distinct(extractor(domain).links(F.col("url"), F.col("html")))).alias("target"))
