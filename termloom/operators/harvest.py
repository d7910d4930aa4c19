"""Harvests of concept definitions: flattening, differences between revisions, and re-indexing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import admissible, concept_of, normal_phrase
from termloom.operators import kb as base
from termloom.operators.scratch import cut

KEY = ["concept", "category"]


def flatten(harvest: DataFrame) -> DataFrame:
    """harvest (concept, url, scheme, categories, synonyms, and other columns) as one row for each distinct normalised name
    (synonyms first) and category. Rows without a category vanish."""
    names = F.concat(F.coalesce("synonyms", F.array().cast("array<string>")), F.array("concept"))
    names = F.array_distinct(F.filter(F.transform(names, normal_phrase), lambda n: n.isNotNull() & (n != "")))
    rest = [c for c in harvest.columns if c not in ("concept", "synonyms", "categories")]
    one = harvest.select(*rest, "categories", F.explode(names).alias("concept"))
    return one.select("concept", F.explode("categories").alias("category"), *rest)


def admissible_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(admissible(F.col("concept")))


def to_delete(old: DataFrame, new: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns)


def to_add(old: DataFrame, new: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return new.join(old.select(*keys).distinct(), keys, "left_anti").select(*new.columns)


def unchanged(old: DataFrame, new: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return old.join(new.select(*keys).distinct(), keys, "left_semi").select(*old.columns)


def reindex(kb: base.KnowledgeBase, pages: DataFrame, harvest: DataFrame, domain: str) -> tuple[base.KnowledgeBase, DataFrame]:
    """pages (url) of a domain, with their harvest (page, concept, url, scheme, categories, synonyms; page being the url of
    the page it is from), brought into kb: the new base, and (url) of the objects to be linked again.

    Per page and (concept, category): rows no longer there are deleted and invalidate what links them, new ones are added,
    others keep their ids, on which edges rest. A new concept invalidates nothing.
    """
    kb = base.settled(base.add_objects(kb, pages.select("url", F.lit(domain).alias("domain"))))
    ids = kb.objects.join(pages.select("url").distinct(), "url", "left_semi").select(F.col("url").alias("page"), "objectid")
    new = cut(admissible_rows(flatten(harvest)).join(ids, "page").withColumn("domain", F.lit(domain)).withColumnRenamed("url", "link"))
    mine = kb.concepts.join(ids.select("objectid"), "objectid", "left_semi").withColumn("concept", concept_of(F.col("firstword"), F.col("tailwords")))
    keys = [*KEY, "objectid"]
    gone = to_delete(mine, new, keys)
    again = base.invalidated(kb, gone)
    kb2 = base.delete_concepts(kb, gone)
    if "scheme" not in new.columns:
        new = new.withColumn("scheme", F.lit(None).cast("string"))
    added = base.add_concepts(base.KnowledgeBase(kb2.objects, kb.concepts, kb2.links), to_add(mine, new, keys))
    fresh = added.concepts.join(kb.concepts.select("conceptid"), "conceptid", "left_anti")
    return base.settled(base.KnowledgeBase(kb2.objects, kb2.concepts.unionByName(fresh.select(*kb2.concepts.columns)), kb2.links)), cut(again)


def skip_known_leaves(kb: base.KnowledgeBase, pages: DataFrame) -> DataFrame:
    """pages (url, leaf) less the leaves that already have concepts; for runs that don't update."""
    have = kb.objects.join(kb.concepts.select("objectid").distinct(), "objectid", "left_semi").select("url", F.lit(True).alias("leaf"))
    return pages.join(have, ["url", "leaf"], "left_anti").select(*pages.columns)
