"""Canonical row text, row hashes, buckets and the order-free checksum.

Two hash modes exist. ``fast`` hashes typed values with ``xxhash64`` and never builds text.
``portable`` hashes an injective JSON text with MD5, so another SQL engine can recompute it.
Both tell ``(null, 'a')`` from ``('a', null)``, which a bare ``xxhash64(*cols)`` does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TEXT = (T.StringType, T.CharType, T.VarcharType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)
#: Two flag bits per column must fit one signed long.
_FLAG_COLUMNS = 31


def quoted(name: str) -> Column:
    """A column reference that survives dots and backticks in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.MapType)


def _sorted_maps(col: Column, dtype: T.DataType) -> Column:
    """The value with every map in it, at any depth, as an array of entries in key order."""
    if not _has_map(dtype):
        return col
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _sorted_maps(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [_sorted_maps(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    entries = F.map_entries(col)
    if _has_map(dtype.valueType):
        entries = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), _sorted_maps(e["value"], dtype.valueType).alias("value")))
    return F.array_sort(entries)


def _common_number(a: T.DataType, b: T.DataType) -> T.DecimalType | None:
    """The decimal type that holds both of two exact numeric types, if there is one."""
    digits, scale = 0, 0
    for t in (a, b):
        if isinstance(t, _INTEGRAL):
            digits = max(digits, 19)
        elif isinstance(t, T.DecimalType):
            digits, scale = max(digits, t.precision - t.scale), max(scale, t.scale)
        else:
            return None
    return T.DecimalType(digits + scale, scale) if digits + scale <= 38 else None


def canonical_text(col: Column, dtype: T.DataType) -> Column:
    """One text per value, independent of session formatting; null stays null."""
    if isinstance(dtype, _TEXT):
        return col.cast("string")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(dtype, T.BinaryType):
        return F.lower(F.hex(col))
    if isinstance(dtype, _NESTED):
        return F.to_json(_sorted_maps(col, dtype), {"ignoreNullFields": "false"})
    if isinstance(dtype, T.VariantType):
        return F.to_json(col)
    return col.cast("string")


def row_text(schema: T.StructType, columns: Sequence[str]) -> Column:
    """Injective text of the listed columns: a JSON array that keeps nulls."""
    return F.to_json(F.array(*[canonical_text(quoted(c), schema[c].dataType) for c in columns]))


def _portable_hash(schema: T.StructType, columns: Sequence[str]) -> Column:
    return F.conv(F.substring(F.md5(row_text(schema, columns)), 1, 15), 16, 10).cast("bigint")


def _typed(name: str, dtype: T.DataType, other: T.DataType) -> tuple[Column, Column | None]:
    """The value to hash and, for floating columns, a negative-zero flag."""
    col = quoted(name)
    if isinstance(dtype, _INTEGRAL) and isinstance(other, _INTEGRAL):
        return col.cast("bigint"), None
    if isinstance(dtype, _TEXT) and isinstance(other, _TEXT):
        return col.cast("string"), None
    if isinstance(dtype, T.DecimalType) or isinstance(other, T.DecimalType):
        if common := _common_number(dtype, other):
            return col.cast(common), None
        if isinstance(dtype, (T.DecimalType, *_INTEGRAL)) and isinstance(other, (T.DecimalType, *_INTEGRAL)):
            text = col.cast("string")
            return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text), None
    if type(dtype) is type(other):
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            # xxhash64 folds -0.0 into 0.0 although their texts differ.
            return col, (col == F.lit(0.0)) & (col.cast("string") == "-0.0")
        if isinstance(dtype, (T.DateType, T.BooleanType, T.BinaryType)):
            return col, None
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return col, None
    return canonical_text(col, dtype), None


def _fast_hash(schema: T.StructType, columns: Sequence[str], other: T.StructType) -> Column:
    parts: list[Column] = []
    for start in range(0, len(columns), _FLAG_COLUMNS):
        flags: list[Column] = []
        values: list[Column] = []
        for i, name in enumerate(columns[start : start + _FLAG_COLUMNS]):
            value, negative_zero = _typed(name, schema[name].dataType, other[name].dataType)
            flags.append(F.when(value.isNull(), F.lit(1 << (2 * i))).otherwise(F.lit(0)).cast("bigint"))
            if negative_zero is not None:
                flags.append(F.when(negative_zero, F.lit(2 << (2 * i))).otherwise(F.lit(0)).cast("bigint"))
            values.append(value)
        mask = flags[0]
        for flag in flags[1:]:
            mask = mask + flag
        parts += [mask, *values]
    return F.xxhash64(*parts)


def row_hash(
    schema: T.StructType,
    columns: Sequence[str],
    *,
    other: T.StructType | None = None,
    portable: bool = False,
) -> Column:
    """64-bit hash of the listed columns.

    ``other`` is the schema of the opposite side. Where the two sides store a column in types
    with different encodings, both hash its canonical text instead of the typed value.
    """
    if not columns:
        raise ValueError("no columns to hash")
    if portable:
        return _portable_hash(schema, columns)
    return _fast_hash(schema, columns, other or schema)


def bucket(hash_col: Column, buckets: int) -> Column:
    """Bucket number in ``[0, buckets)``; ``pmod`` also takes the smallest long.

    ``coalesce`` only declares the result non-null: joins on a nullable expression would add a
    null check that computes the hash a second time.
    """
    return F.coalesce(F.pmod(hash_col, F.lit(buckets)).cast("bigint"), F.lit(0).cast("bigint"))


def limbs(value: Column) -> list[Column]:
    """A long as three limbs of 21 bits, the first signed; long sums of them stay exact for
    10^12 rows and cost a fraction of a wide decimal per row."""
    mask = F.lit((1 << 21) - 1)
    return [F.shiftright(value, 42), F.shiftright(value, 21).bitwiseAND(mask), value.bitwiseAND(mask)]


def exact_sum(value: Column) -> Column:
    """Sum of a long column as ``decimal(38,0)``; null for no values."""
    high, middle, low = (F.sum(limb).cast("decimal(20,0)") for limb in limbs(value))
    weight = lambda bits: F.lit(1 << bits).cast("decimal(14,0)")
    return (high * weight(42) + middle * weight(21) + low).cast("decimal(38,0)")


def checksum(hash_col: Column) -> Column:
    """Order-free sum of hashes; it counts duplicates, and nothing sums to zero."""
    return F.coalesce(exact_sum(hash_col), F.lit(0).cast("decimal(38,0)"))


def key_text(columns: Sequence[str], schema: T.StructType) -> Column:
    """Readable key for reports."""
    return F.concat_ws(
        ",", *[F.coalesce(canonical_text(quoted(c), schema[c].dataType), F.lit("")) for c in columns]
    )
