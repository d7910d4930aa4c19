"""Matches put into their texts as links, or given apart from them."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from termloom.functions.text import with_protocol
from termloom.operators.discover import domain_filter
from termloom.operators.segment import doc_key, doc_keys

CSS = "concept"  # class of a link; of a menu, with an s
RELATION = 'property="http://purl.org/dc/terms/relation" '
NOWHERE = "javascript:void(0)"  # a menu's own target
SHOW = "this.nextSibling.style.display='inline'"  # opens it
HIDDEN = "display: none;"
ICONS: dict[str, str] = {}  # domain: icon URL


def tooltip(domain: Column, icons: dict[str, str]) -> Column:
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in icons.items() for x in kv]), domain) if icons else F.lit(None).cast("string")
    return F.concat(F.lit('<img src="'), F.coalesce(known, F.lit("")), F.lit('" alt="'), F.coalesce(domain, F.lit("")), F.lit('"></img>'))


def links_of(link: Column, multilinks: Column) -> Column:
    """Link, then multilinks, distinct, with protocol."""
    many = F.coalesce(multilinks, F.array().cast("array<string>"))
    all_links = F.filter(F.concat(F.array(link), many), lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(F.transform(all_links, with_protocol))


def spans(matches: DataFrame) -> DataFrame:
    """(doc_id, key, offset_begin, offset_end, links): all links of a span with their domains, those of later matches first; of
    equal links the first stays. Spans without links are left out."""
    keys = doc_keys(matches)
    own = F.transform(links_of(F.col("link"), F.col("multilinks")), lambda x: F.struct(x.alias("link"), F.col("domain").alias("domain")))
    rows = matches.select(*keys, "offset_begin", "offset_end", "conceptid", own.alias("own"))
    g = rows.groupBy(*keys, "offset_begin").agg(F.max("offset_end").alias("offset_end"), F.sort_array(F.collect_list(F.struct("conceptid", "own")), asc=False).alias("rows"))
    g = g.withColumn("flat", F.flatten(F.transform("rows", lambda r: r["own"])))
    first = F.filter("flat", lambda x, i: F.array_position(F.transform("flat", lambda y: y["link"]), x["link"]) == i + 1)
    return g.select(*keys, "offset_begin", "offset_end", first.alias("links")).filter(F.size("links") > 0)


def marks(links: Column, rdfa: bool, icons: dict[str, str]) -> tuple[Column, Column]:
    """What goes before a span's text and what after it: an anchor, or a menu of several links."""
    extra = RELATION if rdfa else ""
    one = F.size(links) == 1
    item = lambda x: F.concat(F.lit(f'<a class="{CSS}" {extra}href="'), x["link"], F.lit('">'), tooltip(x["domain"], icons), F.lit("</a>"))
    head = F.lit(f'<a class="{CSS}s" href="{NOWHERE}" onclick="{SHOW}">')
    menu = F.concat(F.lit(f'</a><sup style="{HIDDEN}">'), F.array_join(F.transform(links, item), ""), F.lit("</sup>"))
    before = F.when(one, F.concat(F.lit(f'<a class="{CSS}" {extra}href="'), links[0]["link"], F.lit('">'))).otherwise(head)
    return before, F.when(one, F.lit("</a>")).otherwise(menu)


@F.pandas_udf(StringType())
def _spliced(texts: pd.Series, begins: pd.Series, ends: pd.Series, befores: pd.Series, afters: pd.Series) -> pd.Series:
    """Texts with marks put in at character offsets, in one pass over each text."""
    out = []
    for text, begin, end, before, after in zip(texts, begins, ends, befores, afters):
        parts, at = [], 0
        for b, e, x, y in zip(begin, end, before, after):
            parts += [text[at:b], x, text[b:e], y]
            at = e
        out.append("".join([*parts, text[at:]]))
    return pd.Series(out, dtype="object")


def embed(docs: DataFrame, matches: DataFrame, annotation: str = "html", domain: str | None = None, icons: dict[str, str] = ICONS) -> DataFrame:
    """(doc_id, annotated, n_links) for all docs (doc_id, text): each span as an anchor, or as a menu of several links.

    annotation: html, or html+rdfa; any other leaves texts as they are. Texts of documents with matches are put together from left to
    right in an Arrow pass, so offsets need no correction and time is linear in text and spans. Null texts stay null. Matches with a
    key belong to the rows of that doc_id and text only; those without one, to all rows of a doc_id.
    """
    if not annotation.lower().startswith("html"):
        return docs.select("doc_id", F.col("text").alias("annotated"), F.lit(0).cast("long").alias("n_links"))
    before, after = marks(F.col("links"), annotation.lower() == "html+rdfa", icons)
    own = spans(domain_filter(matches, domain))
    keys = doc_keys(own)
    own = own.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct("offset_begin", "offset_end", before.alias("before"), after.alias("after"), F.size("links").alias("n")).alias("s"))
    own = own.groupBy(*[f"_{k}" for k in keys]).agg(F.sort_array(F.collect_list("s")).alias("s"))
    base = docs.select("doc_id", "text").withColumn("key", doc_key("text"))
    both = base.join(own, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    n = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    # texts without spans don't go through Python: they get empty arguments
    args = [F.when(F.col("s").isNotNull(), F.col("text")).otherwise(""), *[F.coalesce(F.col("s")[c], F.array().cast(f"array<{t}>")) for c, t in (("offset_begin", "int"), ("offset_end", "int"), ("before", "string"), ("after", "string"))]]
    return both.select("doc_id", F.when(F.col("s").isNull(), F.col("text")).otherwise(_spliced(*args)).alias("annotated"), F.coalesce(n, F.lit(0).cast("long")).alias("n_links"))


def standoff(matches: DataFrame, domain: str | None = None) -> DataFrame:
    """(doc_id, payload): a document's matches as a JSON list, links with protocol, in order of offset and conceptid."""
    m = domain_filter(matches, domain)
    one = F.struct("offset_begin", "offset_end", *_described(F.col("concept")))
    return m.groupBy(*doc_keys(m)).agg(F.to_json(F.sort_array(F.collect_list(one))).alias("payload")).drop("key")


def _described(concept: Column) -> list[Column]:
    own = ["conceptid", concept.alias("concept"), "category", "scheme", "domain"]
    return [*own, with_protocol(F.col("link")).alias("link"), F.transform("multilinks", with_protocol).alias("multilinks")]


def json_of(concept: Column) -> Column:
    """The object of a match in standoff(), but for its place."""
    return F.to_json(F.struct(*_described(concept)))


def response(payload: Column, status: str = "OK", message: str = "") -> Column:
    return F.to_json(F.struct(payload.alias("payload"), F.lit(message).alias("message"), F.lit(status).alias("status")))
