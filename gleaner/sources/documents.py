"""The document model, and the adapter from the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as X

DOCUMENT = "doc_id long, path string, mtime double, size long, lang string, n_lines int, text string, method string, is_dir boolean"
LEDGER = "path string, size long, reason string, seen double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample documents in the schema DOCUMENT."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat("source", F.lit("/doc_"), F.col("doc_id"), F.lit(".md")).alias("path"),
        (F.col("doc_id") * 3600.0).alias("mtime"),
        F.col("n_chars").alias("size"),
        "lang",
        X.line_count(F.col("text")).alias("n_lines"),
        "text",
        F.lit("utf8").alias("method"),
        F.lit(False).alias("is_dir"),
    )
