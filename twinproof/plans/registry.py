"""Registry of queries and their SQL, and inputs that both sides derive the same way."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from twinproof.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name; without SQL only its rows are checked."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


class Derived:
    """A frame computed from one table by expressions that Spark and DuckDB both read.

    Integer division is written ``DIV``.
    """

    def __init__(self, name: str, table: str, columns: Mapping[str, str], where: str | None = None):
        self.name, self.table, self.columns, self.where = name, table, dict(columns), where

    def df(self, spark: SparkSession, folder: str) -> DataFrame:
        df = load(spark, folder, self.table)
        if self.where:
            df = df.filter(self.where)
        return df.selectExpr(*[f"{e} AS `{a}`" for a, e in self.columns.items()])

    @property
    def cte(self) -> str:
        cols = ", ".join(f'{e} AS "{a}"' for a, e in self.columns.items())
        where = f" WHERE {self.where}" if self.where else ""
        return f"{self.name} AS (SELECT {cols} FROM {self.table}{where})".replace(" DIV ", " // ")

    def but(self, name: str, /, where: str | None = None, **columns: str) -> "Derived":
        """A variant with other expressions or another filter."""
        return Derived(name, self.table, {**self.columns, **columns}, where or self.where)


def with_ctes(*inputs: Derived) -> str:
    return "WITH " + ", ".join(d.cte for d in inputs) + " "


def pick(index: str, values: list[str | None]) -> str:
    """CASE that cycles through text values by an integer expression."""
    arms = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)
    )
    return f"CASE ({index}) % {len(values)} {arms} END"
