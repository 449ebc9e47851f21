"""Portable per-column profile and its diff, for sides that encode values differently.

This is weaker than a row hash on purpose: an edit that keeps a text's length is invisible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.functions.canon import exact_sum, quoted

NUMERIC, TEXT, TEMPORAL, BOOLEAN, OTHER = "numeric", "text", "temporal", "boolean", "other"

#: Metrics per type class, in output order.
METRICS = {
    NUMERIC: ("non_null", "sum", "min", "max"),
    TEXT: ("non_null", "char_len_sum"),
    TEMPORAL: ("non_null",),
    BOOLEAN: ("non_null",),
    OTHER: ("non_null",),
}

CAVEAT = "counts and per-column aggregates only; a text edit of equal length is not detected"

_SCALED = T.DecimalType(38, 6)
#: Doubles below this magnitude keep six decimals exactly inside a signed long.
_LONG_SAFE = 9.0e12
#: Up to here 10^12 doubles sum exactly as decimals of six digits behind the point; they have no more.
_SUM_SAFE = 1.0e20


def category(dtype: T.DataType) -> str:
    """Type class of a Spark type."""
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(
        dtype, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType)
    ) or dtype.typeName().startswith("time"):
        return TEMPORAL
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    return OTHER


def category_of_name(type_name: Column) -> Column:
    """Type class of a catalog type name. ``interval`` is temporal although it starts with int."""
    t = F.lower(type_name)
    return (
        F.when(
            t.rlike("^(smallint|integer|bigint|decimal|numeric|real|double precision|money)$")
            | (t.startswith("int") & ~t.startswith("interval"))
            | t.isin("serial", "bigserial"),
            NUMERIC,
        )
        .when(t.rlike("char|text|citext|name|uuid"), TEXT)
        .when(t.rlike("timestamp|date|time|interval"), TEMPORAL)
        .when(t.isin("boolean", "bool"), BOOLEAN)
        .otherwise(OTHER)
    )


def _helpers(i: int, col: Column, dtype: T.DataType, trim_blanks: bool) -> dict[str, Column]:
    """Per-row values that several metrics of a column share, computed once below the aggregate."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        # Values of six decimals or fewer are summed as scaled longs, large ones as decimals; of all others the bits are.
        value = col.cast("double")
        plain, large = _six_decimals(value), F.abs(value).between(F.lit(_LONG_SAFE), F.lit(_SUM_SAFE))
        return {
            f"v{i}": value,
            f"m{i}": F.when(plain, F.rint(value * F.lit(1e6)).cast("bigint")),
            f"w{i}": F.when(large, value.cast(_SCALED)),
            f"r{i}": F.when(~plain & ~large, F.xxhash64(value)),
        }
    if category(dtype) == TEXT:
        return {f"v{i}": F.length(F.rtrim(col) if trim_blanks else col)}
    if category(dtype) in (TEMPORAL, BOOLEAN, OTHER):
        return {f"v{i}": col.isNotNull()}
    return {f"v{i}": col}


def _six_decimals(value: Column) -> Column:
    """Is this double the closest one to a number of six decimals that fits a scaled long? Not so for NaN."""
    return (F.abs(value) < F.lit(_LONG_SAFE)) & (F.rint(value * F.lit(1e6)) / F.lit(1e6) == value)


def _short(text: Column) -> Column:
    """A decimal's text without trailing zeros, so that its scale does not matter."""
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def _metric(i: int, name: str, dtype: T.DataType) -> Column:
    """One metric over the helper columns, as text."""
    v = F.col(f"v{i}")
    if name == "non_null":
        return (F.count_if(v) if category(dtype) in (TEMPORAL, BOOLEAN, OTHER) else F.count(v)).cast("string")
    if name == "char_len_sum":
        return F.sum(v).cast("string")
    if name == "rest":
        bits = F.coalesce(exact_sum(F.col(f"r{i}")), F.lit(0).cast("decimal(38,0)"))
        return F.concat(F.count(f"r{i}").cast("string"), F.lit(":"), bits.cast("string"))
    floating = isinstance(dtype, (T.FloatType, T.DoubleType))
    if name in ("min", "max"):
        bound = F.min(v) if name == "min" else F.max(v)
        if floating:
            return F.when(_six_decimals(bound), bound.try_cast(_SCALED).cast("string")).otherwise(bound.cast("string"))
        return _short(bound.cast("string")) if isinstance(dtype, T.DecimalType) else bound.cast("string")
    if isinstance(dtype, T.DecimalType):
        # Beyond 38 digits the sum of the values' hashes stands for theirs.
        beyond = F.concat(F.lit("hash:"), exact_sum(F.xxhash64(v)).cast("string"))
        return F.when(F.count(v) > 0, F.coalesce(_short(F.try_sum(v).cast("string")), beyond))
    if not floating:
        return exact_sum(v.cast("bigint")).cast("string")
    millionth = F.expr("cast(0.000001 as decimal(7,6))")
    zero = F.lit(0).cast(_SCALED)
    scaled = (exact_sum(F.col(f"m{i}")).cast("decimal(31,0)") * millionth).cast(_SCALED)
    total = F.coalesce(scaled, zero) + F.coalesce(F.sum(f"w{i}"), zero)
    return F.when(F.count(v) > 0, total.cast(_SCALED).cast("string"))


def table_profile(
    df: DataFrame, columns: Sequence[str] | None = None, trim_blanks: bool = False
) -> DataFrame:
    """Long-form profile (column, metric, value) from one aggregation over one scan.

    ``trim_blanks`` measures text length without trailing blanks, as one source dialect does.
    The row count is reported as metric ``row_count`` with a null column. Floating columns have one metric more, ``rest``: how many
    values are neither numbers of six decimals nor between 9e12 and 1e20 (NaN and infinities count here), and an exact checksum of their bits; ``sum`` holds the
    others. Values of any size count, but the metrics are a summary: {1, 3, 3, 5} and {1, 2, 4, 5} have the same.
    """
    names = list(columns) if columns is not None else df.columns
    helpers: dict[str, Column] = {}
    aggs = [F.count("*").cast("string").alias("row_count")]

    def cell(column: str | None, metric: str, alias: str) -> Column:
        return F.struct(
            F.lit(column).cast("string").alias("column"), F.lit(metric).alias("metric"), F.col(alias).alias("value")
        )

    cells = [cell(None, "row_count", "row_count")]
    for i, name in enumerate(names):
        dtype = df.schema[name].dataType
        helpers |= _helpers(i, quoted(name), dtype, trim_blanks)
        floating = isinstance(dtype, (T.FloatType, T.DoubleType))
        for metric in (*METRICS[category(dtype)], *(("rest",) if floating else ())):
            aggs.append(_metric(i, metric, dtype).alias(f"c{i}_{metric}"))
            cells.append(cell(name, metric, f"c{i}_{metric}"))
    projected = df.select(*[c.alias(a) for a, c in helpers.items()])
    return projected.agg(*aggs).select(F.inline(F.array(*cells)))


def _compare(source: DataFrame, target: DataFrame) -> DataFrame:
    """All cells of two profiles side by side, with ``kind`` set where they diverge.

    Both inputs have a few rows per column. A column known to one side only is reported once,
    on its ``non_null`` cell.
    """
    key = [F.coalesce(F.col("column"), F.lit("")).alias("k"), "metric"]
    s = source.select(*key, F.col("value").alias("source"), F.lit(True).alias("in_source"))
    t = target.select(*key, F.col("value").alias("target"), F.lit(True).alias("in_target"))
    side = F.when(F.col("in_target").isNull(), "target").when(F.col("in_source").isNull(), "source")
    absent = side.isNotNull()
    kind = (
        F.when(absent & (F.col("metric") == "non_null"), "column_missing")
        .when(absent | F.col("source").eqNullSafe(F.col("target")), None)
        .when(F.col("metric") == "row_count", "row_count")
        .otherwise("column_metric")
    )
    return s.join(t, ["k", "metric"], "full").select(
        kind.alias("kind"),
        F.nullif("k", F.lit("")).alias("column"),
        F.when(~absent, F.col("metric")).alias("metric"),
        F.when(~absent, F.col("source")).alias("source"),
        F.when(~absent, F.col("target")).alias("target"),
        side.alias("side"),
    )


def diff_profiles(source: DataFrame, target: DataFrame) -> DataFrame:
    """(kind, column, metric, source, target, side) of every divergence."""
    return _compare(source, target).filter(F.col("kind").isNotNull())


def profile_report(name: str, source: DataFrame, target: DataFrame, **kwargs) -> DataFrame:
    """One summary row for a pair, with the caveat that the check is the weaker one."""
    cells = _compare(table_profile(source, **kwargs), table_profile(target, **kwargs))
    rows = F.col("metric") == "row_count"
    return cells.agg(
        F.max(F.when(rows, F.col("source"))).alias("source_rows"),
        F.max(F.when(rows, F.col("target"))).alias("target_rows"),
        F.count("kind").alias("mismatches"),
    ).select(
        F.lit(name).alias("table"),
        "*",
        (F.col("mismatches") == 0).alias("match"),
        F.lit(CAVEAT).alias("caveat"),
    )


def table_sizes(df: DataFrame) -> DataFrame:
    """Row count and payload bytes (text and binary columns) of a table."""
    wide = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))
    ]
    payload = sum((F.coalesce(F.octet_length(quoted(c)), F.lit(0)).cast("bigint") for c in wide), F.lit(0).cast("bigint"))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(payload), F.lit(0)).alias("payload_bytes"))
