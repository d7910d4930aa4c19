"""Subject classes and their similarity."""

import math
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESOURCES = Path(__file__).parent.parent / "resources"
_ABSENT = {2, 4, 7, 9, 10, 21, 23, 24, 25, 27, 29, 36, 38, 48, 50, 56, 59, 61, 63, 64, 66, 67, 69, 71, 72, 73, 75, 77, 79, 84, 87, 88, 89, 95, 96, 98, 99}
CODES = tuple(f"{n:02d}" for n in range(100) if n not in _ABSENT)
SHORTEST = 7  # characters of a concept that takes part in disambiguation


def stop_words() -> list[str]:
    return pq.read_table(RESOURCES / "stopwords.parquet")["word"].to_pylist()


def matrix() -> list[list[float]]:
    t = pq.read_table(RESOURCES / "similarity.parquet")["sim"].to_pylist()
    return [t[k * len(CODES) : (k + 1) * len(CODES)] for k in range(len(CODES))]


def log_matrix() -> list[list[float]]:
    """Natural logarithms; a zero counts as the least logarithm less 1."""
    m = matrix()
    least = min(math.log(x) for row in m for x in row if x) - 1
    return [[math.log(x) if x else least for x in row] for row in m]


def class_index(category: Column) -> Column:
    """0..62 by the first two characters; null for unknown classes."""
    pairs = [x for k, code in enumerate(CODES) for x in (F.lit(code), F.lit(k))]
    return F.try_element_at(F.create_map(*pairs), F.substring(category, 1, 2))


def similarities(spark: SparkSession) -> DataFrame:
    """(i, j, sim, log_sim), 3,969 rows."""
    m, logs = matrix(), log_matrix()
    n = range(len(CODES))
    return spark.createDataFrame([(i, j, m[i][j], logs[i][j]) for i in n for j in n], "i int, j int, sim double, log_sim double")


def with_similarity(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with sim of two category columns; 0 where either is null or unknown."""
    table = F.broadcast(similarities(pairs.sparkSession))
    keyed = pairs.withColumn("_i", class_index(F.col(left))).withColumn("_j", class_index(F.col(right)))
    out = keyed.join(table, (F.col("_i") == F.col("i")) & (F.col("_j") == F.col("j")), "left")
    return out.select(*[pairs[c] for c in pairs.columns], F.coalesce("sim", F.lit(0.0)).alias("sim"), "log_sim")
