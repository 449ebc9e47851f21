"""Catalog dumps as frames: columns, generated flags and key columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.sources.tables import generated_columns

COLUMNS_DDL = "table_name string, column_name string, ordinal int, data_type string, is_generated boolean"


def catalog_of(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Column catalog of live frames; one row per column, read from schemas only."""
    rows = []
    for name, df in tables.items():
        generated = generated_columns(df.schema)
        for i, f in enumerate(df.schema.fields, start=1):
            rows.append((name, f.name, i, f.dataType.simpleString(), f.name in generated))
    return spark.createDataFrame(rows, COLUMNS_DDL)


def non_generated(catalog: DataFrame) -> DataFrame:
    """Columns that may be hashed, in ordinal order within a table."""
    return catalog.filter(~F.col("is_generated"))


def key_columns(indexes: DataFrame, columns: DataFrame) -> DataFrame:
    """Primary-key columns in index order.

    ``indexes`` holds (table_id, is_primary, attnums array); ``columns`` holds
    (table_id, attnum, column_name). The position in the index, not the column's ordinal,
    gives the key order.
    """
    keyed = indexes.filter("is_primary").select(
        "table_id", F.posexplode("attnums").alias("pos", "attnum")
    )
    return keyed.join(columns, ["table_id", "attnum"]).select(
        "table_id", (F.col("pos") + 1).cast("bigint").alias("key_position"), "column_name"
    )


def hash_column_audit(
    live: DataFrame, pinned: DataFrame, by: Sequence[str] = ("table_id",)
) -> DataFrame:
    """Pinned column lists against the live catalog, over many tables at once.

    ``live``: (*by, column_name, is_generated); ``pinned``: (*by, column_name). A table without
    any pinned column hashes automatically and yields no findings.
    """
    by = list(by)
    tables = pinned.select(*by).distinct()
    live = live.join(tables, by, "left_semi")
    joined = live.withColumn("_live", F.lit(True)).join(
        pinned.withColumn("_pinned", F.lit(True)), [*by, "column_name"], "full"
    )
    finding = (
        F.when(F.col("_live").isNull(), "nonexistent")
        .when(F.col("_pinned").isNull() & ~F.col("is_generated"), "missing_from_pinned")
        .when(F.col("_pinned").isNotNull() & F.col("is_generated"), "generated_pinned")
    )
    return joined.select(*by, "column_name", finding.alias("finding")).filter("finding is not null")
