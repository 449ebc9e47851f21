"""Schema history: which columns a table had at a position, so that each image is opened with the schema of its time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.operators.changes import BAD_IMAGE, BAD_OP, NO_IMAGE, NULL_KEY, OPS

NO_SCHEMA = "no schema in force"


@dataclass(frozen=True)
class Version:
    """Columns from position ``since`` on: name, type of the JSON value, and the expression that makes today's value of it (``{}``
    stands for the value; None takes it as it is)."""

    since: object
    columns: tuple[tuple[str, str, str | None], ...]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind, _ in self.columns))


@dataclass(frozen=True)
class SchemaHistory:
    """Versions of all tables in one folder, beside the stream's offsets. A version is written under its table and position, so a
    replayed note replaces itself."""

    path: str

    def record(self, spark: SparkSession, table: str, version: Version) -> None:
        rows = [(i, name, kind, how) for i, (name, kind, how) in enumerate(version.columns)]
        since = F.lit(version.since)
        out = spark.createDataFrame(rows, "ordinal int, column string, type string, decode string").select(since.alias("since"), "*")
        out.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/table={table}/since={version.since}")

    def versions(self, spark: SparkSession, table: str) -> list[Version]:
        """Versions of a table by rising position; a table has a few, one for each change of its columns."""
        found = spark.read.parquet(f"{self.path}/table={table}/since=*").orderBy("since", "ordinal").collect()
        since = list(dict.fromkeys(r["since"] for r in found))
        return [Version(s, tuple((r["column"], r["type"], r["decode"]) for r in found if r["since"] == s)) for s in since]


def version_in_force(versions: Sequence[Version], pos: str = "pos") -> Column:
    """Index of the version at a position; null before the first and for an unknown position."""
    out = F.lit(None).cast("int")
    for i, v in sorted(enumerate(versions), key=lambda x: x[1].since):
        out = F.when(F.col(pos) >= F.lit(v.since), F.lit(i)).otherwise(out)
    return out


def open_as_of(changes: DataFrame, versions: Sequence[Version], target: T.StructType, keys: Sequence[str]) -> DataFrame:
    """op, pos, the columns of ``target`` and ``_reason`` for changes (op, pos, before, after) in JSON.

    An image is read with the version in force at its position, then turned into today's columns; those that it did not have are null. What
    cannot be opened keeps a reason and null columns. One pass, whatever the number of versions.
    """
    raw = F.coalesce("after", "before")
    out = changes.withColumn("_version", version_in_force(versions))
    parsed = {}
    for i, v in enumerate(versions):
        schema = T.StructType([*v.schema.fields, T.StructField("_corrupt", T.StringType())])
        parsed[f"_image{i}"] = F.when(F.col("_version") == i, F.from_json(raw, schema, {"columnNameOfCorruptRecord": "_corrupt"}))
    out = out.withColumns(parsed)

    def today(i: int, v: Version) -> Column:
        own = {name: (F.col(f"_image{i}.`{name}`"), how, f"_image{i}.`{name}`") for name, _, how in v.columns}
        fields = []
        for f in target.fields:
            value = F.lit(None)
            if f.name in own:
                column, how, text = own[f.name]
                value = column if how is None else F.expr(how.format(text))
            fields.append(value.cast(f.dataType).alias(f.name))
        return F.struct(*fields)

    row, corrupt = F.lit(None).cast(target), F.lit(None).cast("string")
    for i, v in enumerate(versions):
        row = F.when(F.col("_version") == i, today(i, v)).otherwise(row)
        corrupt = F.when(F.col("_version") == i, F.when(F.col(f"_image{i}").isNull(), "null").otherwise(F.col(f"_image{i}._corrupt"))).otherwise(corrupt)
    out = out.withColumns({"_row": row, "_corrupt": corrupt})
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col("_row").getField(k).isNull()
    reason = (
        F.when(~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), BAD_OP)
        .when(raw.isNull(), NO_IMAGE)
        .when(F.col("_version").isNull(), NO_SCHEMA)
        .when(F.col("_corrupt").isNotNull(), BAD_IMAGE)
        .when(no_key, NULL_KEY)
    )
    out = out.withColumn("_reason", reason)
    return out.select("op", "pos", *[F.when(F.col("_reason").isNull(), F.col("_row").getField(n)).alias(n) for n in target.names], "_reason")
