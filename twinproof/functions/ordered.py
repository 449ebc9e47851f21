"""Look-back and running counts over ordered samples without one task per series.

A plain window puts a whole series on one task. Here a series is cut at sampled positions if it has more than ``rows`` rows or more
than its share of all rows, one in ``cuts``; windows run inside (series, piece), and one small row per piece carries what
the next piece needs to know. Results equal those of the plain window.

However many rows there are, about ``PIECES`` pieces are the most: beyond ``rows * PIECES`` rows the pieces grow instead. So boundaries
and carried rows are bounded tables (at most 2 * PIECES + cuts * cuts rows) and are broadcast, and the samples are shuffled
once. A row finds its piece by a binary search in the boundaries of its series, made of plain expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Choose it near the number of tasks.
CUTS = 64
#: Rows of a piece.
ROWS = 1 << 22
#: Pieces of all series together, about; at most the square of ``_GROUP``.
PIECES = 1 << 16
#: Boundaries that one look-up searches, a power of two.
_GROUP = 256
#: Sampled positions per boundary.
_SAMPLES = 32
_KEY, _PIECE = "_series", "_piece"


def _pieces(df: DataFrame, series: Sequence[str], order: str, cuts: int, rows: int = ROWS) -> DataFrame:
    """Add the series as one struct (which joins to itself even where a column in it is null) and the piece, null where the series
    is not cut. The sample is chosen by hash, so every evaluation cuts alike."""
    df = df.withColumn(_KEY, F.struct(*[F.col(c) for c in series]))
    sizes = df.groupBy(_KEY).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).scalar()
    by_size = F.ceil(F.col("_n") / F.greatest(F.lit(rows), F.ceil(total / PIECES)))
    by_share = F.when(F.col("_n") * cuts > total, cuts).otherwise(1)
    long = sizes.withColumn("_parts", F.greatest(by_size, by_share).cast("int")).filter("_parts > 1")  # at most PIECES + cuts rows
    every = F.greatest(F.floor(F.col("_n") / (F.col("_parts") * _SAMPLES)), F.lit(1))
    sample = df.select(_KEY, order).join(F.broadcast(long), _KEY).filter(F.pmod(F.xxhash64(_KEY, order), every) == 0)
    sample = sample.groupBy(_KEY, "_parts").agg(F.sort_array(F.collect_list(order)).alias("_s"))  # about _parts * _SAMPLES values each
    at = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda i: F.element_at("_s", (F.size("_s") * i.cast("long") / F.col("_parts")).cast("int") + 1))
    bounds = sample.select(_KEY, F.array_distinct(at).alias("_bounds"))
    # Two levels, so that no row carries a long array: every _GROUP-th boundary, then those of one group.
    coarse = bounds.select(_KEY, F.filter("_bounds", lambda b, i: i % _GROUP == 0).alias("_bounds"))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("_bounds") - 1) / _GROUP)), lambda g: F.slice("_bounds", (g * _GROUP + 1).cast("int"), _GROUP))
    fine = bounds.filter("size(_bounds) > 0").select(_KEY, F.posexplode(groups).alias("_group", "_fine"))
    df = df.join(F.broadcast(coarse), _KEY, "left").withColumn("_group", F.when(F.col("_bounds").isNotNull(), _passed("_bounds", order) - 1))
    df = df.drop("_bounds").join(F.broadcast(fine), [_KEY, "_group"], "left")
    piece = F.greatest(F.col("_group"), F.lit(0)) * _GROUP + _passed("_fine", order)
    return df.withColumn(_PIECE, F.when(F.col("_group").isNotNull(), piece)).drop("_group", "_fine")


def _passed(bounds: str, order: str) -> Column:
    """How many boundaries of a sorted array lie at or below a row's position, by binary search; none for a null array."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(_GROUP.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(F.col(bounds), at + step - 1) <= F.col(order), step).otherwise(0))


def with_previous(df: DataFrame, series: Sequence[str], order: str, columns: Sequence[str], cuts: int = CUTS, rows: int = ROWS) -> DataFrame:
    """Add ``prev_<c>`` for each column, and ``has_prev``. ``order`` must be unique within a series."""
    df = _pieces(df, series, order, cuts, rows)
    inside = Window.partitionBy(_KEY, _PIECE).orderBy(order)
    across = Window.partitionBy(_KEY).orderBy(_PIECE)
    payload = F.struct(*[F.col(c) for c in columns])
    carried = (
        df.filter(F.col(_PIECE).isNotNull())
        .groupBy(_KEY, _PIECE)
        .agg(F.max_by(payload, F.col(order)).alias("_last"))
        .select(_KEY, _PIECE, F.lag("_last").over(across).alias("_carry"))
    )
    out = df.withColumn("_in", F.lag(payload).over(inside)).join(F.broadcast(carried), [_KEY, _PIECE], "left")
    # A struct from the window is null only where the piece starts.
    prev = F.coalesce(F.col("_in"), F.col("_carry"))
    out = out.withColumn("_prev", prev).withColumn("has_prev", F.col("_prev").isNotNull())
    for c in columns:
        out = out.withColumn(f"prev_{c}", F.col(f"_prev.{c}"))
    return out.drop("_in", "_carry", "_prev", _KEY, _PIECE)


def with_running_count(df: DataFrame, series: Sequence[str], order: str, condition: Column, name: str, cuts: int = CUTS, rows: int = ROWS) -> DataFrame:
    """Add the number of rows up to and including this one that satisfy ``condition``."""
    df = _pieces(df, series, order, cuts, rows)
    flag = F.when(condition, 1).otherwise(0).cast("bigint")
    inside = Window.partitionBy(_KEY, _PIECE).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(_KEY).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.filter(F.col(_PIECE).isNotNull())
        .groupBy(_KEY, _PIECE)
        .agg(F.sum(flag).alias("_hits"))
        .select(_KEY, _PIECE, F.coalesce(F.sum("_hits").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        df.withColumn("_inside", F.sum(flag).over(inside))
        .join(F.broadcast(offsets), [_KEY, _PIECE], "left")
        .withColumn(name, F.col("_inside") + F.coalesce("_offset", F.lit(0).cast("bigint")))
        .drop("_inside", "_offset", _KEY, _PIECE)
    )
