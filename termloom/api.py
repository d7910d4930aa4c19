"""Entry points: link documents, index pages."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import canonical_url, with_protocol
from termloom.operators import annotate, classify, crawl, discover, harvest, linking, segment
from termloom.operators.kb import KnowledgeBase, add_objects, relink, settled
from termloom.sources import extractors


@dataclass(frozen=True)
class LinkOptions:
    format: str = "html"  # or text; another gives no matches, and texts as they are
    annotation: str = "html"  # html+rdfa; json (with embed=False)
    embed: bool = True
    domain: str = "all"
    include_all: bool = False  # no disambiguation


def find_matches(docs: DataFrame, kb: KnowledgeBase, options: LinkOptions = LinkOptions()) -> tuple[DataFrame, DataFrame]:
    """(matches after disambiguation, matches before it, from which edges are made) of docs (doc_id, text[, url])."""
    own = segment.once(docs.select("doc_id", "text"))
    if options.format.lower() == "html":
        runs = segment.html_runs(own.select("doc_id", F.col("text").alias("html")))
    else:
        runs = segment.text_runs(own if options.format.lower() == "text" else own.limit(0))
    urls = docs.select("doc_id", "url") if "url" in docs.columns else None
    found = discover.discover(runs, kb.concepts, urls, linking.found(runs, kb.concepts))
    return classify.disambiguate(found, options.include_all), found


def link_documents(docs: DataFrame, kb: KnowledgeBase, options: LinkOptions = LinkOptions()) -> DataFrame:
    """Embedded: (doc_id, annotated, n_links) for all docs. Apart: (doc_id, payload) as JSON, or the matches themselves."""
    matches, _ = find_matches(docs, kb, options)
    if options.embed:
        return annotate.embed(docs, matches, options.annotation, options.domain)
    if options.annotation.lower() == "json":
        return annotate.standoff(matches, options.domain)
    return discover.domain_filter(matches, options.domain)


def link_and_record(docs: DataFrame, kb: KnowledgeBase, domain: str, options: LinkOptions = LinkOptions()) -> tuple[DataFrame, KnowledgeBase]:
    """link_documents() of docs (doc_id, text, url), and kb with their links: each url becomes an object of the domain if it is none yet,
    and its edges are replaced by those to the concepts found, before disambiguation, so that their changes invalidate it. Docs
    with a null or empty url are linked, but not recorded."""
    named = docs.filter("url is not null and url <> ''").select("doc_id", canonical_url(F.col("url")).alias("url"))
    kb = settled(add_objects(kb, named.select("url", F.lit(domain).alias("domain"))))
    _, found = find_matches(docs, kb, options)
    objects = named.join(kb.objects.select("url", "objectid"), "url").select("doc_id", "objectid").distinct()
    return link_documents(docs, kb, options), settled(relink(kb, discover.edges(found, objects), objects))


def _revisions(pages: DataFrame) -> DataFrame:
    """pages with canonical urls, one revision of each: the greatest html (null least). Categories handed down are united."""
    own = pages.filter("url is not null").withColumn("url", canonical_url(F.col("url"))).filter("url <> ''")
    more = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("categories")] if "categories" in pages.columns else []
    return own.groupBy("url").agg(F.max("html").alias("html"), *more)


def index_pages(pages: DataFrame, kb: KnowledgeBase, domain: str, update: bool = True) -> tuple[KnowledgeBase, DataFrame]:
    """pages (url, html[, categories]) of a domain into kb: the new base, and the urls of the objects to be linked again.

    Urls are canonical throughout: http, https and www forms of a page are one page, of whose revisions in pages the greatest html
    counts. Without update, pages that define concepts already stay as they are. Rows without a url are left out."""
    own = _revisions(pages)
    if not update:
        own = harvest.skip_known_leaves(kb, own.withColumn("leaf", F.lit(True))).drop("leaf")
    # site rules read full addresses
    full = own.withColumn("url", with_protocol(F.col("url")))
    return harvest.reindex(kb, own, extractors.harvest(full, domain), domain[:1].upper() + domain[1:].lower())


def index_domain(pages: DataFrame, kb: KnowledgeBase, domain: str, start: DataFrame, update: bool = True, blocked: bool = True) -> tuple[KnowledgeBase, DataFrame]:
    """Those of pages (url, html) that the domain's own links reach from start (url), within its depth, indexed by index_pages().

    A page hands its category to the pages that it links, or else what was handed to it; a page reached from several gets all of theirs.
    Categories of the shipped block list (unless blocked is false) are visited but lead no further."""
    rules = extractors.extractor(domain)
    own = _revisions(pages)
    full = own.withColumn("url", with_protocol(F.col("url")))
    links = extractors.links(full, domain).select(canonical_url(F.col("url")).alias("url"), canonical_url(F.col("target")).alias("target"))
    first = start.select(canonical_url(F.col("url")).alias("url"))
    stop = None
    if blocked and rules.category:
        stop = full.withColumn("name", rules.category(F.col("url"))).join(F.broadcast(extractors.blocked_categories(full.sparkSession)), "name").select(canonical_url(F.col("url")).alias("url"))
    seen = crawl.breadth_first(links, first, rules.depth, stop)
    reached = own.join(seen.select("url", "depth"), "url")
    if rules.category:
        named = reached.withColumn("name", rules.category(with_protocol(F.col("url"))))
        parents = named.select("url", "name", F.col("depth").alias("above")).filter("name is not null")
        handed = links.join(parents, "url").select(F.col("target").alias("url"), "name").groupBy("url").agg(F.array_sort(F.collect_set("name")).alias("categories"))
        reached = reached.join(handed, "url", "left")
    return index_pages(reached.drop("depth"), kb, domain, update)


def default_base(spark: SparkSession, path: str) -> KnowledgeBase:
    """The base under path: what callers without one of their own use; an empty one is made there if none is."""
    if not KnowledgeBase.has(spark, path, 0):
        KnowledgeBase.empty(spark).write(path, 0)
    return KnowledgeBase.read(spark, path)
