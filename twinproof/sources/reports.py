"""JSON-lines report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from twinproof.functions.canon import quoted


def ordered(report: DataFrame, *first: str | Column) -> DataFrame:
    """Rows by the given columns, then by all others in turn: an order without ties but for equal rows."""
    named = {c for c in first if isinstance(c, str)}
    rest = [quoted(f.name) for f in report.schema.fields if f.name not in named and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return report.orderBy(*[quoted(c) if isinstance(c, str) else c for c in first], *rest)


def write_report(report: DataFrame, path: str) -> str:
    """Write one JSON object per row and return the path; existing reports are never replaced."""
    report.write.mode("errorifexists").json(path)
    return path


def read_report(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path)


def write_draft(drafts: DataFrame, decisions: DataFrame, folder: str) -> None:
    """DDL as text and open decisions as JSON lines, for review; nothing is applied."""
    drafts.select("ddl").write.mode("errorifexists").text(f"{folder}/ddl")
    write_report(decisions, f"{folder}/decisions")
