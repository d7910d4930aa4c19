"""A concept dictionary from the benchmark table, for tables that come without a knowledge base."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.functions.classes import CODES
from termloom.functions.text import normalised
from termloom.operators.discover import stop_filter
from termloom.operators.segment import text_runs, words

DOMAINS = ("alpha", "beta", "gamma")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of 1 to 3 normalised words that begin at any word of an item and aren't split by marks; the first no stop word. Numbered by length and name; every fifth has a second link in the same domain, and every seventh one in another."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    one = stop_filter(words(text_runs(items), 2)).select(F.col("doc_id").alias("item_id"), "word", "n1", "n2")
    one = normalised(one, w1="word", w2="n1", w3="n2")
    two, three = (F.col("w2") != ""), (F.col("w2") != "") & (F.col("w3") != "")
    grams = F.array(F.nullif("w1", F.lit("")), F.when(two, F.concat_ws(" ", "w1", "w2")), F.when(three, F.concat_ws(" ", "w1", "w2", "w3")))
    grams = F.when(F.col("w1") != "", grams)
    named = one.select("item_id", F.explode(grams).alias("concept")).filter("concept is not null").groupBy("concept").agg(F.min("item_id").alias("item_id"))
    named = named.withColumn("n_words", F.size(F.split("concept", " ")))
    # the benchmark table is small: one window numbers its concepts
    named = named.withColumn("n", F.row_number().over(Window.orderBy("n_words", "concept")))
    listed = lambda xs: "array(" + ", ".join(f"'{x}'" for x in xs) + ")"
    domain = lambda n: f"get({listed(DOMAINS)}, int(({n}) % {len(DOMAINS)}))"
    row = lambda n, d, x: f"struct(bigint({n}) AS conceptid, {d} AS domain, {x} AS link)"
    link = "concat('example.org/', item_id)"
    copies = f"""array_compact(array({row("n", domain("n"), link)},
        CASE WHEN n % 5 = 0 THEN {row("n + 1000000", domain("n"), f"concat({link}, '/more')")} END,
        CASE WHEN n % 7 = 0 THEN {row("n + 2000000", domain("n + 1"), "concat('http://other.example.org/', item_id)")} END))"""
    category = F.expr(f"concat(get({listed(CODES)}, int(n % {len(CODES)})), '-XX')")
    out = named.select("concept", category.alias("category"), "item_id", F.explode(F.expr(copies)).alias("r"))
    first = F.split("concept", " ", 2)
    return out.select("r.conceptid", first[0].alias("firstword"), F.coalesce(F.get(first, F.lit(1)), F.lit("")).alias("tailwords"), "category", F.lit("msc").alias("scheme"), "r.domain", "r.link", F.col("item_id").alias("objectid"))
