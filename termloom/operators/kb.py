"""The knowledge base: objects, concepts and the links cache as DataFrames, and changes to them as new DataFrames."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.functions.text import concept_of, first_word, tail_words
from termloom.operators.discover import side
from termloom.operators.scratch import cut

OBJECTS = "objectid long, url string, domain string, modified timestamp"
CONCEPTS = "conceptid long, firstword string, tailwords string, category string, scheme string, domain string, link string, objectid long"
LINKS = "objectid long, conceptid long"


@dataclass
class KnowledgeBase:
    objects: DataFrame
    concepts: DataFrame
    links: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> "KnowledgeBase":
        return cls(*[spark.createDataFrame([], s) for s in (OBJECTS, CONCEPTS, LINKS)])

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "KnowledgeBase":
        """The newest whole version under path; an empty one if there is none."""
        versions = [n for n in _versions(spark, path) if _exists(spark, f"{path}/{n}/links/_SUCCESS")]
        if not versions:
            return cls.empty(spark)
        at = f"{path}/{versions[-1]}"
        return cls(*[spark.read.parquet(f"{at}/{n}") for n in ("objects", "concepts", "links")])

    @staticmethod
    def has(spark: SparkSession, path: str, version: int) -> bool:
        return _exists(spark, f"{path}/v{version:08d}/links/_SUCCESS")

    def write(self, path: str, version: int | None = None) -> None:
        """As a new version beside the former ones (after them, unless its number is given), so that no table is overwritten while it
        is read; links come last and make a version whole. Of a version that broke off, what is there is replaced. Ids come
        from written tables (see numbered()), so all three agree however often they are computed."""
        if version is None:
            version = max((int(n[1:]) for n in _versions(self.objects.sparkSession, path)), default=-1) + 1
        for name in ("objects", "concepts", "links"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/v{version:08d}/{name}")


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def _versions(spark: SparkSession, path: str) -> list[str]:
    fs, p = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v")) if fs.exists(p) else []


def settled(kb: KnowledgeBase) -> KnowledgeBase:
    """kb as written tables: each change reads its base several times, so a chain of changes would grow its plan by that factor."""
    return KnowledgeBase(cut(kb.objects), cut(kb.concepts), cut(kb.links))


def _hashed(objects: DataFrame) -> DataFrame:
    """Objects to be joined with edges, of which they have many each: edges are parted by object, but not sorted."""
    return objects.hint("shuffle_hash")


def numbered(rows: DataFrame, known: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with ids above the largest of known, dense and in the given order. Ranges are sorted apart and counted; a row's
    number is its place in its range after all earlier ranges, so no single task sees all rows. The ranges come from a
    sample and a lost task may be run again: rows are written with their range before any is numbered."""
    base = known.agg(F.coalesce(F.max(key), F.lit(0)).alias("base"))
    parts = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    sizes = parts.groupBy("_part").count()
    ahead = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    out = parts.withColumn("_in", inside).join(F.broadcast(ahead), "_part").crossJoin(F.broadcast(base))  # a row for each range, and one row
    return out.withColumn(key, (F.col("base") + F.col("_ahead") + F.col("_in")).cast("long")).drop("_part", "_in", "_ahead", "base")


def add_objects(kb: KnowledgeBase, rows: DataFrame) -> KnowledgeBase:
    """rows (url, domain) become objects unless a part is missing or the url is known."""
    new = rows.select("url", "domain").dropna().filter("url <> '' and domain <> ''").groupBy("url").agg(F.min("domain").alias("domain"))
    new = numbered(new.join(kb.objects.select("url"), "url", "left_anti"), kb.objects, "objectid", "url")
    new = new.select("objectid", "url", "domain", F.current_timestamp().alias("modified"))
    return KnowledgeBase(kb.objects.unionByName(new), kb.concepts, kb.links)


def touched(kb: KnowledgeBase, urls: DataFrame) -> KnowledgeBase:
    """The objects of urls (url) get the present time as `modified`; the others keep theirs."""
    again = urls.select("url").distinct().withColumn("_again", F.lit(True))
    objects = kb.objects.join(again, "url", "left").withColumn("modified", F.when(F.col("_again"), F.current_timestamp()).otherwise(F.col("modified")))
    return KnowledgeBase(objects.select(*kb.objects.columns), kb.concepts, kb.links)


def object_by(kb: KnowledgeBase, url: str | None = None, objectid: int | None = None) -> DataFrame:
    return kb.objects.filter(F.col("url") == url) if url is not None else kb.objects.filter(F.col("objectid") == objectid)


def concept_rows(rows: DataFrame) -> DataFrame:
    """rows (concept, category, objectid, link, domain, scheme) in the form of the concepts table, without ids: required
    fields present, lower case, scheme msc by default, split into first word and tail."""
    r = rows.dropna(subset=["concept", "category", "objectid", "link", "domain"])
    c = F.lower("concept")
    out = r.select(first_word(c).alias("firstword"), tail_words(c).alias("tailwords"), "category", F.coalesce("scheme", F.lit("msc")).alias("scheme"), "domain", "link", "objectid")
    return out.filter("firstword is not null and category <> '' and link <> '' and domain <> ''")


def add_concepts(kb: KnowledgeBase, rows: DataFrame) -> KnowledgeBase:
    new = numbered(concept_rows(rows), kb.concepts, "conceptid", "objectid", "firstword", "tailwords", "category", "link")
    return KnowledgeBase(kb.objects, kb.concepts.unionByName(new.select(*kb.concepts.columns)), kb.links)


def concepts_of(kb: KnowledgeBase, objectid: int, concept: str | None = None, category: str | None = None, scheme: str | None = None) -> DataFrame:
    """The concepts of an object, with their whole names; of one name, category and scheme if all three are given."""
    out = kb.concepts.filter(F.col("objectid") == objectid).withColumn("concept", concept_of(F.col("firstword"), F.col("tailwords")))
    if concept and category and scheme:
        out = out.filter((F.col("concept") == concept) & (F.col("category") == category) & (F.col("scheme") == scheme))
    return out


def adjacent(kb: KnowledgeBase, conceptid: int | None = None, objectid: int | None = None) -> DataFrame:
    """(objectid) of the objects that link a concept, or (conceptid) of the concepts that an object links; of neither, no rows."""
    if conceptid is not None:
        return kb.links.filter(F.col("conceptid") == conceptid).select("objectid")
    return kb.links.filter(F.col("objectid") == (objectid if objectid is not None else F.lit(None))).select("conceptid")


def delete_concepts(kb: KnowledgeBase, rows: DataFrame) -> KnowledgeBase:
    """Every concept equal to one of rows (concept, category, objectid) in first word, tail, category and objectid goes; scheme isn't
    looked at; domain is if rows has it. Its edges go with it."""
    c = F.lower("concept")
    more = [F.col("domain").alias("d")] if "domain" in rows.columns else []
    gone = rows.select(first_word(c).alias("f"), F.coalesce(tail_words(c), F.lit("")).alias("t"), F.col("category").alias("c"), F.col("objectid").alias("o"), *more).distinct()
    k = kb.concepts
    same = (k.firstword == gone.f) & (F.coalesce(k.tailwords, F.lit("")) == gone.t) & (k.category == gone.c) & (k.objectid == gone.o)
    if more:
        same = same & (k.domain == gone.d)
    kept = k.join(gone, same, "left_anti")
    return KnowledgeBase(kb.objects, kept, kb.links.join(kept.select("conceptid"), "conceptid", "left_semi").select("objectid", "conceptid"))


def relink(kb: KnowledgeBase, edges: DataFrame, objects: DataFrame) -> KnowledgeBase:
    """The edges of objects (objectid) are replaced by theirs in edges (objectid, conceptid)."""
    old = kb.links.join(_hashed(objects.select("objectid").distinct()), "objectid", "left_anti")
    return KnowledgeBase(kb.objects, kb.concepts, old.unionByName(edges.select("objectid", "conceptid").dropna()).distinct())


def invalidated(kb: KnowledgeBase, conceptids: DataFrame) -> DataFrame:
    """(url) of the objects that link one of conceptids, once for each edge."""
    return kb.links.join(side(conceptids.select("conceptid").distinct()), "conceptid").join(_hashed(kb.objects), "objectid").select("url")


def merge(kbs: list[KnowledgeBase]) -> KnowledgeBase:
    """Objects and concepts of several bases under new dense ids, in order of base and former id. Edges follow their ids."""
    tag = lambda df, k: df.withColumn("source", F.lit(k))
    union = lambda name: reduce(DataFrame.unionByName, [tag(getattr(kb, name), k) for k, kb in enumerate(kbs)])
    empty = kbs[0].objects.sparkSession.createDataFrame([], LINKS)
    o = numbered(union("objects").withColumnRenamed("objectid", "old"), empty, "objectid", "source", "old")
    ids = o.select("source", F.col("old").alias("objectid"), F.col("objectid").alias("new"))
    c = union("concepts").join(ids, ["source", "objectid"]).withColumn("objectid", F.col("new")).drop("new")
    c = numbered(c.withColumnRenamed("conceptid", "old"), empty, "conceptid", "source", "old")
    names = c.select("source", F.col("old").alias("conceptid"), F.col("conceptid").alias("renamed"))
    own = lambda df, k: df.filter(F.col("source") == k).drop("source")
    # edges are many beside objects and concepts: those of a base are shuffled once, and not sorted
    e = [kb.links.join(side(own(names, k)), "conceptid").join(_hashed(own(ids, k)), "objectid").select(F.col("new").alias("objectid"), F.col("renamed").alias("conceptid")) for k, kb in enumerate(kbs)]
    cols = [x.split()[0] for x in OBJECTS.split(", ")], [x.split()[0] for x in CONCEPTS.split(", ")]
    return KnowledgeBase(o.select(*cols[0]), c.select(*cols[1]), reduce(DataFrame.unionByName, e))
