"""Append-only ledger of written ids: one id per text line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_ledger(lines: DataFrame) -> DataFrame:
    """Trimmed, non-blank ids of a single-column text frame."""
    return lines.select(F.trim(F.col(lines.columns[0])).alias("id")).filter(F.length("id") > 0)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return parse_ledger(spark.read.text(path))


def append_ledger(ids: DataFrame, column: str | Column, path: str) -> None:
    col = F.col(column) if isinstance(column, str) else column
    ids.select(col.cast("string").alias("value")).write.mode("append").text(path)
