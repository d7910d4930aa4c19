"""Queries of the training-data operators with production parameters, each over its whole table, and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import chat, decontam, jaccard, langid, licenses, mixing, pii, secrets, sharding, vectors
from termloom.llm._io import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_windows": lambda spark, sf_dir: chat.windows(table(spark, sf_dir, "conversations")),
    "op2_embedding_near_dedup": lambda spark, sf_dir: vectors.near_duplicates(table(spark, sf_dir, "embeddings")),
    "op3_language_id": lambda spark, sf_dir: langid.identify(_docs(spark, sf_dir)),
    "op4_secrets": lambda spark, sf_dir: secrets.find(_docs(spark, sf_dir)),
    "op5_pii": lambda spark, sf_dir: pii.find(_docs(spark, sf_dir)),
    "op6_ngram_jaccard": lambda spark, sf_dir: jaccard.near_duplicates(_docs(spark, sf_dir)),
    "op7_mixing": lambda spark, sf_dir: mixing.rates(_docs(spark, sf_dir), table(spark, sf_dir, "labels")),
    "op8_decontamination": lambda spark, sf_dir: decontam.contaminated(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark")),
    "op9_sharding": lambda spark, sf_dir: sharding.cut_points(_docs(spark, sf_dir)),
    "op10_licenses": lambda spark, sf_dir: licenses.scan_documents(_docs(spark, sf_dir)),
}

ORACLES: dict[str, str] = {"op1_chat_windows": chat.ORACLE, "op2_embedding_near_dedup": vectors.ORACLE, "op9_sharding": sharding.ORACLE}
