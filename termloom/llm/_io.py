"""Tables, scratch tables in the cluster's shared folder, and size-checked joins."""

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BROADCAST_ROWS = 1_000_000  # most id rows that may be broadcast; more are joined by a shuffle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where none is set, a folder of our own, which is then set, but only in local mode (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='termloom-')}"
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table made by cut() that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/t-" in path:
            _delete(df.sparkSession, path)


def join_ids(df: DataFrame, ids: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join with a table of ids that was cut(): broadcast up to BROADCAST_ROWS rows, by a shuffle beyond."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, on, how)


def body(text: Column) -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(text, F.lit(""))
