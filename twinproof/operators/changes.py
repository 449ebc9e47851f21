"""Ordered change apply: routing, latest change per key, merge, multiset apply, new tables.

A change row carries ``op`` (``c``, ``u``, ``d``), an orderable position ``pos``, the key
columns and the after-image columns. Later positions win; equal work twice changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.functions.canon import quoted

DELETE = "d"
#: Copies of one row that a single task emits when multiplicities are expanded.
_COPIES_PER_TASK = 100_000


def route_pattern(prefix: str, segments: int = 1) -> str:
    """Regex that strips ``prefix.`` and ``segments`` further dotted parts from a topic."""
    return "^" + re.escape(prefix) + r"\.[^.]+" * segments + r"\.(.*)$"


def route(
    changes: DataFrame,
    prefix: str,
    *,
    segments: int = 1,
    include: Sequence[str] | None = None,
    topic: str = "topic",
) -> DataFrame:
    """Add ``table`` and ``routed``. Unmatched topics stay in the frame with a null table."""
    pattern = route_pattern(prefix, segments)
    table = F.when(F.col(topic).rlike(pattern), F.regexp_extract(topic, pattern, 1))
    out = changes.withColumn("table", table)
    allowed = F.col("table").isin(*include) if include is not None else F.lit(True)
    return out.withColumn("routed", F.coalesce(F.col("table").isNotNull() & allowed, F.lit(False)))


def open_images(changes: DataFrame, schema: T.StructType) -> DataFrame:
    """(op, pos, columns) from JSON row images: the after-image, or the before-image of a delete."""
    image = F.from_json(F.coalesce("after", "before"), schema)
    return changes.select("op", "pos", image.alias("_image")).select("op", "pos", "_image.*")


#: Why a change cannot be applied.
BAD_IMAGE, NO_IMAGE, NULL_KEY, BAD_OP = "malformed image", "no image", "null key", "unknown operation"
OPS = ("c", "u", "d", "r")


def checked_images(changes: DataFrame, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """``changes`` with ``_image``, the opened row image, and ``_reason``, null for a change that can be applied.

    An image that is broken JSON or has a value of another type than its column is malformed: nothing of it is used. A change
    without an image, with a null in its key or with an operation other than create, update, delete or read is none either.
    """
    raw = F.coalesce("after", "before")
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    out = changes.withColumn("_image", F.from_json(raw, wide, {"columnNameOfCorruptRecord": "_corrupt"}))
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col("_image").getField(k).isNull()
    reason = (
        F.when(~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), BAD_OP)
        .when(raw.isNull(), NO_IMAGE)
        .when(F.col("_image").isNull() | F.col("_image._corrupt").isNotNull(), BAD_IMAGE)
        .when(no_key, NULL_KEY)
    )
    return out.withColumn("_reason", reason).withColumn("_image", F.col("_image").dropFields("_corrupt"))


def same_key(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality of the keys of two aliased frames; nulls in a key equal each other."""
    out = F.lit(True)
    for i, k in enumerate(keys):
        one = F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
        out = one if i == 0 else out & one
    return out


def latest_per_key(changes: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """The change with the highest position per key.

    ``max_by`` merges on the map side, so a key that holds most of the changes sends one row
    per task to its reducer.
    """
    rest = [c for c in changes.columns if c not in keys and c != pos]
    best = F.max_by(F.struct(*[quoted(c) for c in rest]), quoted(pos)).alias("_last")
    return (
        changes.groupBy(*[quoted(k) for k in keys])
        .agg(F.max(quoted(pos)).alias(pos), best)
        .select(*keys, pos, "_last.*")
    )


def merge(
    snapshot: DataFrame,
    latest: DataFrame,
    keys: Sequence[str],
    op: str = "op",
    pos: str = "pos",
    add_columns: bool = False,
) -> DataFrame:
    """Upsert or delete one change per key into a snapshot.

    Untouched rows pass through an anti join, which Spark broadcasts while the changes are
    small; the snapshot's payload never enters an aggregation. With ``add_columns``, columns
    that only the changes have are appended; otherwise they are left out. Nulls in a key equal each other.
    """
    keep = snapshot.alias("_s").join(latest.select(*[quoted(k) for k in keys]).alias("_l"), same_key("_s", "_l", keys), "left_anti")
    upserts = latest.filter(F.col(op) != DELETE)
    if add_columns:
        return evolve(keep, upserts.drop(op, pos))
    return keep.unionByName(upserts.select(*snapshot.columns))


def apply_changes(
    snapshot: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    high_water: int | Column | None = None,
    op: str = "op",
    pos: str = "pos",
) -> DataFrame:
    """Snapshot taken at ``high_water`` plus the changes after it, with no gap or overlap."""
    if high_water is not None:
        changes = changes.filter(quoted(pos) > high_water)
    return merge(snapshot, latest_per_key(changes, keys, pos), keys, op, pos)


def high_waters(applied: DataFrame, pos: str = "pos") -> DataFrame:
    """Per-table high-water mark of applied positions."""
    return applied.groupBy("table").agg(F.max(pos).alias("high_water"))


def after_high_water(changes: DataFrame, marks: Mapping[str, int | Column], pos: str = "pos") -> DataFrame:
    """Changes after their own table's mark; a table added later brings its own snapshot mark.

    ``marks`` has one position per replicated table, of the type of ``pos``: a number, padded text, a struct. Tables
    without a mark have no snapshot yet and yield nothing.
    """
    kind = changes.schema[pos].dataType
    own = F.lit(False)
    for table, mark in marks.items():
        own = F.when(F.col("table") == table, quoted(pos) > (mark if isinstance(mark, Column) else F.lit(mark)).cast(kind)).otherwise(own)
    return changes.filter(own)


def apply_multiset(
    snapshot: DataFrame, changes: DataFrame, op: str = "op", before: str = "before", after: str = "after"
) -> DataFrame:
    """Apply changes to a table without a key; the whole old row names the row.

    Inserts count +1, deletes -1, updates do both. Returns the distinct rows with ``copies``.
    """
    cols = snapshot.columns
    minus = F.when(F.col(op) != "c", F.struct(F.col(f"{before}.*"), F.lit(-1).alias("_n")))
    plus = F.when(F.col(op) != DELETE, F.struct(F.col(f"{after}.*"), F.lit(1).alias("_n")))
    signed = changes.select(F.explode(F.array_compact(F.array(minus, plus))).alias("r")).select("r.*")
    return (
        snapshot.select(*cols, F.lit(1).alias("_n"))
        .unionByName(signed.select(*cols, "_n"))
        .groupBy(*[quoted(c) for c in cols])
        .agg(F.sum("_n").alias("copies"))
        .filter("copies > 0")
    )


def expand_copies(counted: DataFrame, copies: str = "copies") -> DataFrame:
    """Turn (row, copies) back into single rows; heaps of equal rows spread over many tasks."""
    cols = [c for c in counted.columns if c != copies]
    n = quoted(copies)
    few = counted.filter(n <= _COPIES_PER_TASK).select(*cols, F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("_i"))
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / _COPIES_PER_TASK))).alias("_chunk")
    many = counted.filter(n > _COPIES_PER_TASK).select(*cols, n.alias("_n"), chunk)
    size = F.least(F.lit(_COPIES_PER_TASK), F.col("_n") - F.col("_chunk") * _COPIES_PER_TASK).cast("int")
    many = many.repartition(*cols, "_chunk").select(*cols, F.explode(F.sequence(F.lit(1), size)).alias("_i"))
    return few.unionByName(many).drop("_i")


def split_unknown_fields(
    changes: DataFrame, after_map: str, known: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Policy ``none``: changes whose after-image has unknown fields go to quarantine."""
    unknown = F.array_except(F.map_keys(after_map), F.array(*[F.lit(k) for k in known]))
    tagged = changes.withColumn("unknown_fields", F.coalesce(F.array_sort(unknown), F.array().cast("array<string>")))
    ok = tagged.filter(F.size("unknown_fields") == 0).drop("unknown_fields")
    return ok, tagged.filter(F.size("unknown_fields") > 0)


def added_fields(changes: DataFrame, after_map: str, known: Sequence[str]) -> DataFrame:
    """Policy ``basic``: the columns a target must gain, with the first position that needs them."""
    return (
        changes.select("pos", F.explode(F.map_keys(after_map)).alias("field"))
        .filter(~F.col("field").isin(*known))
        .groupBy("field")
        .agg(F.min("pos").alias("first_pos"), F.count("*").alias("changes"))
    )


def evolve(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Policy ``basic`` on frames: add new columns, never drop or retype one."""
    for name in set(target.columns) & set(incoming.columns):
        if target.schema[name].dataType != incoming.schema[name].dataType:
            raise ValueError(f"column {name} changed its type; only added columns are accepted")
    return target.unionByName(incoming, allowMissingColumns=True)


def orphan_rows(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Child rows whose reference has no parent row; null references are allowed."""
    parents = parent.select(*[quoted(p).alias(c) for c, p in on.items()])
    present = child
    for c in on:
        present = present.filter(quoted(c).isNotNull())
    return present.join(parents, list(on), "left_anti")
