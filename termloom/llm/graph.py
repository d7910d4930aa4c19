"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.llm._io import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a, b), root being the component's smallest node.

    Alternates the large-star and small-star steps until nothing changes, a number of rounds logarithmic in the
    component size. Each step is a window minimum, so a node with very many neighbours spills rather than filling a list.
    """
    e = cut(edges.select("a", "b").filter("a <> b").distinct())
    seen = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = F.least("a", F.min("b").over(Window.partitionBy("a")))
        large = both.withColumn("m", low).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        star = down.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = star.select("a", F.col("m").alias("b")).union(star.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        new = cut(small.distinct())
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(e)
        e = new
        if state == seen:
            break
        seen = state
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b")).distinct()
