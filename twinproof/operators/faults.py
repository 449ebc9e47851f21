"""Fault injection on a copy, so that each check can be shown to fire.

Faults are column expressions over one pass of the input; nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUFFIX = "_corrupted"


def lose_rows(df: DataFrame, lost: Column) -> DataFrame:
    return df.filter(~lost)


def corrupt_rows(df: DataFrame, column: str, hit: Column) -> DataFrame:
    """Append a suffix to a text column; keys and counts stay the same."""
    return df.withColumn(column, F.when(hit, F.concat(F.col(column), F.lit(SUFFIX))).otherwise(F.col(column)))


def drift_derived(df: DataFrame, column: str) -> DataFrame:
    """Change a generated column only; parity must still pass."""
    return df.withColumn(column, F.reverse(F.col(column)))


def drop_identity(catalog: DataFrame, hit: Column) -> DataFrame:
    """Clear the replica identity of some tables in a catalog dump."""
    return catalog.withColumn("identity", F.when(hit, F.lit("n")).otherwise(F.col("identity")))


def stall(samples: DataFrame, position: str, at: Column) -> DataFrame:
    """The consumer stops confirming at a position while the log keeps growing."""
    return samples.withColumn(position, F.least(F.col(position), at))


def desync(identities: DataFrame, back: Column) -> DataFrame:
    """Put next values behind the largest key in use."""
    return identities.withColumn("next_value", F.col("next_value") - back)


def skewed_copy(df: DataFrame, key: str, column: str, lost: Column, corrupt: Column, extra: Column) -> DataFrame:
    """A target with lost, corrupted and extra rows, from a single pass over the source.

    Extra rows get the key ``-1 - key``, which no generated key uses.
    """
    copies = F.flatten(
        F.array(
            F.when(lost, F.array().cast("array<int>")).otherwise(F.array(F.lit(0))),
            F.when(extra, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")),
        )
    )
    out = df.withColumn("_copy", F.explode(copies))
    original = F.col("_copy") == 0
    return out.select(
        *[
            F.when(original, F.col(c)).otherwise(-1 - F.col(c)).alias(c)
            if c == key
            else F.when(original & corrupt, F.concat(F.col(c), F.lit(SUFFIX))).otherwise(F.col(c)).alias(c)
            if c == column
            else F.col(c)
            for c in df.columns
        ]
    )


def fault_matrix(outcomes: Sequence[tuple[str, bool, DataFrame]]) -> DataFrame:
    """(fault, expected, observed, caught) from one-row frames with a boolean ``fails``.

    ``expected`` says whether the check should fail under that fault.
    """
    rows = [
        found.select(
            F.lit(name).alias("fault"),
            F.lit(expected).alias("expected"),
            F.col("fails").alias("observed"),
            (F.col("fails") == F.lit(expected)).alias("caught"),
        )
        for name, expected, found in outcomes
    ]
    return reduce(DataFrame.unionByName, rows)
