"""Contiguous shards of equal size by global prefix sums of bytes."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.llm._io import body, cut

SHARD_BYTES = 16 << 20


def cut_points(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_rows, n_bytes, byte_start, shard_id) for each distinct doc_id, in doc_id order.

    byte_start is the number of UTF-8 bytes of all texts of smaller doc_ids. With total bytes T there are
    n = max(1, round(T / shard_bytes)) shards, and shard_id = floor(byte_start * n / T): shards are contiguous
    in doc_id, and each misses its equal target by less than one doc_id's bytes. Rows that share a doc_id
    stay together; a null doc_id comes first; a null or empty text has 0 bytes; other columns are not read; an
    empty table gives no rows. If T is 0 all rows are in shard 0.

    The only data shuffled are (doc_id, bytes), partially summed. Each range partition adds up its bytes, the
    few totals are summed up in front of each partition, and offsets within a partition come from a window that
    stays in it, so no step passes through one task.
    """
    size = docs.select("doc_id", F.octet_length(body(F.col("text"))).cast("long").alias("n_bytes"))
    # the range sort samples its input and a lost task may be run again: the table is written before it is split
    sized = cut(size.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.sum("n_bytes").alias("n_bytes")))
    parts = cut(sized.repartitionByRange(F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id()))
    totals = parts.groupBy("part").agg(F.sum("n_bytes").alias("bytes"))
    ahead = totals.select(  # one row for each partition
        "part",
        F.coalesce(F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    n = F.greatest(F.lit(1), F.round(F.col("total") / F.lit(shard_bytes)).cast("long"))
    out = parts.withColumn("before", F.coalesce(F.sum("n_bytes").over(inside), F.lit(0))).join(F.broadcast(ahead), "part")
    out = out.withColumn("byte_start", F.col("before") + F.col("ahead"))
    # decimals: byte_start * n is beyond a long at 100 TB
    exact = F.floor(F.col("byte_start").cast("decimal(20,0)") * n.cast("decimal(12,0)") / F.col("total").cast("decimal(20,0)"))
    shard = F.when(F.col("total") > 0, F.least(exact.cast("long"), n - 1)).otherwise(F.lit(0).cast("long"))
    return out.select("doc_id", "n_rows", "n_bytes", "byte_start", shard.alias("shard_id"))


def shard_documents(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with shard_id (replacing a column of that name), all rows. Texts are not shuffled: a shard is a range of
    doc_ids, so its first doc_id, one row for each shard, is all that a scan needs to place its rows."""
    first = cut(cut_points(docs, shard_bytes).filter(F.col("doc_id").isNotNull()).groupBy("shard_id").agg(F.min("doc_id").alias("doc_id")))
    bounds = sorted((r.doc_id, r.shard_id) for r in first.collect())  # one for each shard
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast((np.array([b[0] for b in bounds], np.int64), np.array([0] + [b[1] for b in bounds], np.int64)))

    @F.pandas_udf("long")
    def place(doc_id: pd.Series) -> pd.Series:
        low, shard = known.value
        at = np.searchsorted(low, doc_id.fillna(-(1 << 63)).to_numpy(np.int64), side="right")
        return pd.Series(np.where(at > 0, shard[at], 0))

    return docs.drop("shard_id").withColumn("shard_id", place("doc_id"))


ORACLE = f"""
WITH g AS (SELECT doc_id, count(*) AS n_rows, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents GROUP BY doc_id),
s AS (SELECT *, CAST(coalesce(sum(n_bytes) OVER (ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start,
  CAST(sum(n_bytes) OVER () AS BIGINT) AS total FROM g),
n AS (SELECT *, greatest(1, CAST(round(total / {SHARD_BYTES}) AS BIGINT)) AS n FROM s)
SELECT doc_id, n_rows, n_bytes, byte_start, CASE WHEN total = 0 THEN 0 ELSE least(CAST(CAST(byte_start AS HUGEINT) * n // total AS BIGINT), n - 1) END AS shard_id FROM n
"""
