"""Columnar and text sources: Parquet tables, whole text files, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id: the path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that doesn't parse keeps its text in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
