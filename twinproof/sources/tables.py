"""Table scans and the source/target pair that parity jobs compare."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from twinproof.session import pin


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Scan a file table (parquet, orc, json, csv, text)."""
    pin(spark)
    return spark.read.format(fmt).options(**options).load(path)


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Scan ``<folder>/<table>.parquet``."""
    return read_table(spark, f"{folder.rstrip('/')}/{table}.parquet")


def jdbc_options(
    url: str,
    table: str,
    *,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    **extra: str,
) -> dict[str, str]:
    """Options for a JDBC scan, split into ranges of a numeric key when bounds are given."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **extra}
    if key is not None:
        if bounds is None or partitions < 2:
            raise ValueError("a partitioned scan needs bounds and at least two partitions")
        options |= {
            "partitionColumn": key,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, **kwargs) -> DataFrame:
    """Scan a database table; the driver's dialect does the identifier quoting."""
    pin(spark)
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **kwargs)).load()


def generated_columns(schema: T.StructType) -> set[str]:
    """Columns marked ``{"generated": true}`` in their field metadata."""
    return {f.name for f in schema.fields if f.metadata.get("generated")}


def mark_generated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attach the generated-column mark."""
    for name in columns:
        df = df.withMetadata(name, {"generated": True})
    return df


@dataclass(frozen=True)
class TablePair:
    """The same table on both sides.

    ``keys`` empty means the table has no key: the whole row identifies itself. ``columns``
    pins the compared columns; otherwise all source columns that are not generated are used.
    """

    name: str
    source: DataFrame
    target: DataFrame
    keys: Sequence[str] = ()
    columns: Sequence[str] | None = None
    casts: Mapping[str, str] = field(default_factory=dict)

    @property
    def hash_columns(self) -> list[str]:
        if self.columns is not None:
            names = list(self.columns)
        else:
            generated = generated_columns(self.source.schema)
            names = [f.name for f in self.source.schema.fields if f.name not in generated]
        if not names:
            raise ValueError(f"{self.name}: no columns to compare")
        return names

    @property
    def key_columns(self) -> list[str]:
        return list(self.keys) or self.hash_columns

    @property
    def keyless(self) -> bool:
        """The whole compared row is the key."""
        return self.key_columns == self.hash_columns

    def sides(self) -> tuple[DataFrame, DataFrame]:
        """Both sides narrowed to the columns that the comparison reads."""
        needed = list(dict.fromkeys([*self.key_columns, *self.hash_columns]))
        missing = [c for c in needed if c not in self.target.columns or c not in self.source.columns]
        if missing:
            raise ValueError(f"{self.name}: columns missing on one side: {', '.join(missing)}")
        return self._narrow(self.source, needed), self._narrow(self.target, needed)

    def _narrow(self, df: DataFrame, needed: list[str]) -> DataFrame:
        return df.select(
            *[df[c].cast(self.casts[c]).alias(c) if c in self.casts else df[c] for c in needed]
        )
