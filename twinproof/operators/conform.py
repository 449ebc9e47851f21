"""Type conformance: catalog types to target types with review notes, DDL, and row casts.

Works on catalog dumps of many databases at once. Notes mark mappings that a person must
confirm before cutover.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.functions.canon import exact_sum, quoted
from twinproof.functions.scalars import cut_fraction, sql_identifier
from twinproof.session import shared_dir

# Source types that map to one target type without further conditions.
MYSQL_DIRECT = {
    "mediumint": "integer",
    "float": "real",
    "double": "double precision",
    "tinytext": "text",
    "text": "text",
    "mediumtext": "text",
    "longtext": "text",
    "binary": "bytea",
    "varbinary": "bytea",
    "tinyblob": "bytea",
    "blob": "bytea",
    "mediumblob": "bytea",
    "longblob": "bytea",
    "date": "date",
    "year": "smallint",
    "enum": "text",
    "set": "text",
    "json": "jsonb",
}
MYSQL_SPATIAL = (
    "geometry",
    "point",
    "linestring",
    "polygon",
    "multipoint",
    "multilinestring",
    "multipolygon",
    "geometrycollection",
    "geomcollection",
)
SQLSERVER_DIRECT = {
    "tinyint": "smallint",
    "smallint": "smallint",
    "int": "integer",
    "bigint": "bigint",
    "bit": "boolean",
    "money": "numeric(19,4)",
    "smallmoney": "numeric(10,4)",
    "float": "double precision",
    "real": "real",
    "date": "date",
    "datetime": "timestamp",
    "smalldatetime": "timestamp",
    "text": "text",
    "ntext": "text",
    "binary": "bytea",
    "varbinary": "bytea",
    "image": "bytea",
    "uniqueidentifier": "uuid",
    "xml": "xml",
    "timestamp": "bytea",
    "rowversion": "bytea",
    "hierarchyid": "text",
    "geography": "text",
    "geometry": "text",
    "sql_variant": "text",
}
MAX_FRACTION = 6

# Review notes, in our own words.
NOTE_TINYINT = "one-digit tinyint read as boolean; use smallint if it holds numbers"
NOTE_UNSIGNED_INT = "unsigned int widened to bigint"
NOTE_UNSIGNED_BIG = "unsigned bigint exceeds bigint, numeric instead"
NOTE_BITS = "bit string, check the width"
NOTE_DATETIME = "no zone in the source; fix the session zone so that values align"
NOTE_YEAR = "year stored as smallint"
NOTE_ENUM = "enum as text; add a check or an enum type if wanted"
NOTE_SET = "set arrives comma-joined; text, or an array with a check"
NOTE_SPATIAL = "spatial value arrives as WKB text"
NOTE_UNMAPPED = "no mapping for this type, text by default"
NOTE_GENERATED = "generated column drafted as plain so captured values can be written"
NOTE_COMPUTED = "computed column drafted as plain so captured values can be written"
NOTE_IDENTITY = "identity column drafted as plain; resync the sequence at cutover"
NOTE_FRACTION = "fractional seconds cut to six digits"
NOTE_XML = "xml kept; text if the target cannot handle it"
NOTE_ROWVERSION = "row version stamp, not a time; usually dropped on the target"
NOTE_NO_EQUIVALENT = "no clean equivalent, text"


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def _with_precision(base: str, precision: Column) -> Column:
    p = F.coalesce(precision.cast("int"), F.lit(0))
    return F.when(p > 0, F.concat(F.lit(base + "("), p.cast("string"), F.lit(")"))).otherwise(F.lit(base))


def _numeric() -> Column:
    return F.concat(
        F.lit("numeric("),
        F.coalesce("numeric_precision", F.lit(38)).cast("string"),
        F.lit(","),
        F.coalesce("numeric_scale", F.lit(0)).cast("string"),
        F.lit(")"),
    )


def _sized(base: str, size: Column) -> Column:
    return F.concat(F.lit(base + "("), size.cast("string"), F.lit(")"))


def translate_mysql(catalog: DataFrame) -> DataFrame:
    """Add ``target_type`` and ``review`` to MySQL catalog rows."""
    dt, ct = F.lower("data_type"), F.lower("column_type")
    unsigned = F.contains(ct, F.lit("unsigned"))
    one_digit = (dt == "tinyint") & ct.startswith("tinyint(1)")
    declared = F.nullif(F.regexp_extract(ct, r"\((\d+)\)", 1), F.lit("")).cast("int")
    fraction = F.when(F.col("datetime_precision") > 0, F.col("datetime_precision")).otherwise(
        F.coalesce(declared, F.lit(0))
    )
    length = F.col("character_maximum_length")
    target = (
        F.when(one_digit, "boolean")
        .when(dt == "tinyint", "smallint")
        .when(dt == "smallint", F.when(unsigned, "integer").otherwise("smallint"))
        .when(dt.isin("int", "integer"), F.when(unsigned, "bigint").otherwise("integer"))
        .when(dt == "bigint", F.when(unsigned, "numeric").otherwise("bigint"))
        .when(dt.isin("decimal", "numeric"), _numeric())
        .when(dt == "bit", F.when(ct == "bit(1)", "boolean").otherwise("bit varying"))
        .when(dt == "char", _sized("char", F.coalesce(length, F.lit(1))))
        .when(dt == "varchar", _sized("varchar", F.coalesce(length, F.lit(255))))
        .when(dt.isin("datetime", "timestamp"), _with_precision("timestamptz", fraction))
        .when(dt == "time", _with_precision("time", fraction))
        .otherwise(F.coalesce(_lookup(MYSQL_DIRECT, dt), F.lit("text")))
    )
    known = dt.isin(
        *MYSQL_DIRECT, *MYSQL_SPATIAL,
        "tinyint", "smallint", "int", "integer", "bigint", "decimal", "numeric", "bit", "char", "varchar",
        "datetime", "timestamp", "time",
    )
    note = (
        F.when(one_digit, NOTE_TINYINT)
        .when(dt.isin("int", "integer") & unsigned, NOTE_UNSIGNED_INT)
        .when((dt == "bigint") & unsigned, NOTE_UNSIGNED_BIG)
        .when((dt == "bit") & (ct != "bit(1)"), NOTE_BITS)
        .when(dt == "datetime", NOTE_DATETIME)
        .when(dt == "year", NOTE_YEAR)
        .when(dt == "enum", NOTE_ENUM)
        .when(dt == "set", NOTE_SET)
        .when(dt.isin(*MYSQL_SPATIAL), NOTE_SPATIAL)
        .when(~known, NOTE_UNMAPPED)
    )
    generated = F.when(F.contains(F.upper(F.coalesce("extra", F.lit(""))), F.lit("GENERATED")), NOTE_GENERATED)
    return catalog.withColumn("target_type", target).withColumn("review", _notes(note, generated))


def translate_sqlserver(catalog: DataFrame) -> DataFrame:
    """Add ``target_type`` and ``review`` to SQL Server catalog rows."""
    dt = F.lower("data_type")
    fraction = F.coalesce("datetime_precision", F.lit(0))
    cut = F.least(fraction, F.lit(MAX_FRACTION))
    length = F.coalesce("character_maximum_length", F.lit(0))
    fractional = dt.isin("time", "datetime2", "datetimeoffset")
    target = (
        F.when(dt.isin("decimal", "numeric"), _numeric())
        .when(dt == "time", _with_precision("time", cut))
        .when(dt == "datetime2", _with_precision("timestamp", cut))
        .when(dt == "datetimeoffset", _with_precision("timestamptz", cut))
        .when(dt.isin("char", "nchar"), _sized("char", F.when(length > 0, length).otherwise(1)))
        .when(dt.isin("varchar", "nvarchar") & (length == -1), "text")
        .when(dt.isin("varchar", "nvarchar"), _sized("varchar", F.when(length > 0, length).otherwise(255)))
        .otherwise(F.coalesce(_lookup(SQLSERVER_DIRECT, dt), F.lit("text")))
    )
    known = fractional | dt.isin(*SQLSERVER_DIRECT, "decimal", "numeric", "char", "nchar", "varchar", "nvarchar")
    note = (
        F.when(fractional & (fraction > MAX_FRACTION), NOTE_FRACTION)
        .when(dt.isin("datetime", "smalldatetime", "datetime2"), NOTE_DATETIME)
        .when(dt == "xml", NOTE_XML)
        .when(dt.isin("timestamp", "rowversion"), NOTE_ROWVERSION)
        .when(dt.isin("geography", "geometry"), NOTE_SPATIAL)
        .when(dt.isin("hierarchyid", "sql_variant"), NOTE_NO_EQUIVALENT)
        .when(~known, NOTE_UNMAPPED)
    )
    # Computed wins over identity.
    overlay = F.when(F.col("is_computed") == 1, NOTE_COMPUTED).when(F.col("is_identity") == 1, NOTE_IDENTITY)
    return catalog.withColumn("target_type", target).withColumn("review", _notes(note, overlay))


def _notes(*notes: Column) -> Column:
    return F.nullif(F.concat_ws("; ", *notes), F.lit(""))


def create_tables(translated: DataFrame, by: Sequence[str], table: str = "table_name") -> DataFrame:
    """One CREATE TABLE text per table.

    A table's columns form one group; databases bound it at some thousand columns.
    """
    line = F.concat(
        F.lit("  "),
        sql_identifier(F.col("column_name")),
        F.lit(" "),
        F.col("target_type"),
        F.when(F.upper("is_nullable") == "YES", "").otherwise(" NOT NULL"),
    )
    columns = F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line"))))
    keys = F.sort_array(
        F.collect_list(
            F.when(
                F.col("key_position").isNotNull(),
                F.struct("key_position", sql_identifier(F.col("column_name")).alias("name")),
            )
        )
    )
    grouped = translated.groupBy(*by, table).agg(columns.alias("_columns"), keys.alias("_keys"))
    names = F.array_join(F.transform("_keys", lambda k: k["name"]), ", ")
    key_line = F.when(
        F.size("_keys") > 0, F.array(F.concat(F.lit("  PRIMARY KEY ("), names, F.lit(")")))
    ).otherwise(F.array().cast("array<string>"))
    body = F.array_join(F.concat(F.transform("_columns", lambda c: c["line"]), key_line), ",\n")
    ddl = F.concat(
        F.lit('CREATE TABLE IF NOT EXISTS "public".'), sql_identifier(F.col(table)), F.lit(" (\n"), body, F.lit("\n);")
    )
    return grouped.select(*by, table, ddl.alias("ddl"))


def decisions(translated: DataFrame) -> DataFrame:
    """Columns whose mapping a person has to confirm."""
    return translated.filter(F.col("review").isNotNull())


def manifest(translated: DataFrame, by: Sequence[str]) -> DataFrame:
    """Unsigned draft per group: tables, columns, open decisions, and an order-free checksum of all that the DDL and the decisions show.

    Each part goes in with its length, so no two drafts read alike; an absent part has none.
    """
    shown = {c: F.col(c).cast("string") for c in ("table_name", "column_name", "target_type", "review", "ordinal", "key_position") if c in translated.columns}
    if "is_nullable" in translated.columns:
        shown["is_nullable"] = F.when(F.upper("is_nullable") == "YES", "null").otherwise("not null")
    seen = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown.values()]
    line = F.conv(F.substring(F.md5(F.concat(*seen)), 1, 12), 16, 10).cast("bigint")
    return (
        translated.withColumn("_line", line)
        .groupBy(*by)
        .agg(
            exact_sum(F.col("_line")).cast("string").alias("draft"),
            F.count_distinct("table_name").alias("tables"),
            F.count("*").alias("columns"),
            F.count("review").alias("decisions"),
        )
        .withColumn("signed_off", F.lit(False))
    )


def sign_off(drafts: DataFrame, approvals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mark drafts as approved where an approval names this very draft; any change of the draft needs a new approval."""
    a = approvals.select(*by, F.col("draft")).distinct().withColumn("_seen", F.lit(True))
    return (
        drafts.join(a, [*by, "draft"], "left")
        .withColumn("signed_off", F.coalesce("_seen", F.lit(False)))
        .drop("_seen")
        .select(*drafts.columns)
    )


@dataclass(frozen=True)
class Cast:
    """How one column is conformed; ``kind`` is ``cast``, ``bool``, ``zero_date``, ``set`` or ``time``."""

    column: str
    kind: str
    to: str = ""


_RANGES = {"tinyint": 7, "smallint": 15, "int": 31, "integer": 31, "bigint": 63}
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _guarded(col: Column, dtype: T.DataType | None, to: str) -> Column:
    """``try_cast`` behind a test that most unfit values fail: each one that reaches the cast costs an exception."""
    bits = _RANGES.get(to.lower())
    if bits and isinstance(dtype, T.NumericType):
        if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return F.when(col.between(F.lit(-(1 << bits)).cast("bigint"), F.lit((1 << bits) - 1).cast("bigint")), col.try_cast(to))
        # Fractions are cut off, so the open interval reaches one further down; doubles have no such number below -2^63.
        kind = "decimal(20,0)" if isinstance(dtype, T.DecimalType) else "double"
        low = F.lit(str(-(1 << bits) - 1)).cast(kind)
        above = col >= low if kind == "double" and bits == 63 else col > low
        return F.when(above & (col < F.lit(str(1 << bits)).cast(kind)), col.try_cast(to))
    if isinstance(dtype, T.StringType) and (bits or to.lower().startswith(("decimal", "numeric", "double", "float"))):
        special = F.lower(F.trim(col)).rlike("^[+-]?(nan|inf|infinity)$") if to.lower().startswith(("double", "float")) else F.lit(False)
        return F.when(col.rlike(_NUMBER) | special, col.try_cast(to))
    return col.try_cast(to)


def conform_expr(cast: Cast, dtype: T.DataType | None = None) -> Column:
    """Cast that yields null for a value the target type cannot hold; ``dtype`` is the type it comes from."""
    col = quoted(cast.column)
    if cast.kind == "cast":
        return _guarded(col, dtype, cast.to)
    if cast.kind == "bool":
        return F.when(col.isNotNull(), col != 0)
    if cast.kind == "zero_date":
        return col.try_cast(cast.to or "date")
    if cast.kind == "set":
        return F.when(col == "", F.array().cast("array<string>")).otherwise(F.split(col, ","))
    if cast.kind == "time":
        return cut_fraction(col, MAX_FRACTION)
    raise ValueError(f"unknown cast kind {cast.kind!r}")


def conform_rows(df: DataFrame, casts: Sequence[Cast]) -> DataFrame:
    """Apply the casts; other columns pass through."""
    by_name = {c.column: c for c in casts}
    return df.select(
        *[conform_expr(by_name[c], df.schema[c].dataType).alias(c) if c in by_name else quoted(c) for c in df.columns]
    )


def conform_report(df: DataFrame, casts: Sequence[Cast]) -> DataFrame:
    """Values per column that became null through the cast."""
    aggs, cells = [F.count("*").alias("_rows")], []
    for i, cast in enumerate(casts):
        lost = quoted(cast.column).isNotNull() & conform_expr(cast, df.schema[cast.column].dataType).isNull()
        aggs += [F.count(quoted(cast.column)).alias(f"_v{i}"), F.count_if(lost).alias(f"_l{i}")]
        cells.append(
            F.struct(
                F.lit(cast.column).alias("column"),
                F.lit(cast.kind).alias("kind"),
                F.col(f"_v{i}").alias("values"),
                F.col(f"_l{i}").alias("new_nulls"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


class Conformed(NamedTuple):
    """``rows``: conformed, null where a value did not fit; ``rejects``: (keys, column, text, reason) of each such value; ``counts``: as
    :func:`conform_report`."""

    rows: DataFrame
    rejects: DataFrame
    counts: DataFrame


def _reason(cast: Cast, dtype: T.DataType) -> Column:
    if cast.kind == "zero_date":
        return F.lit("no such date")
    if isinstance(dtype, T.NumericType):
        return F.lit("out of range")
    return F.when(quoted(cast.column).cast("string").rlike(_NUMBER), "out of range").otherwise("not of the type")


def conform_split(df: DataFrame, casts: Sequence[Cast], keys: Sequence[str]) -> Conformed:
    """Conform all rows in one pass that also sets unfit values aside with their text and takes the counts.

    The rows are written once, each with what was rejected of it; both results read their own columns of that table, and the counts are
    observed on the way, so the source is evaluated once. A value that is null in the source is no reject.
    """
    spark = df.sparkSession
    own = [c.column for c in casts]
    fits = {c.column: conform_expr(c, df.schema[c.column].dataType) for c in casts}
    names = {c: f"_to{i}" for i, c in enumerate(own)}
    wide = df.withColumns({names[c]: e for c, e in fits.items()})
    aggs, found = [], []
    for i, c in enumerate(casts):
        lost = quoted(c.column).isNotNull() & F.col(names[c.column]).isNull()
        aggs += [F.count(quoted(c.column)).alias(f"v{i}"), F.count_if(lost).alias(f"l{i}")]
        value = F.struct(F.lit(c.column).alias("column"), quoted(c.column).cast("string").alias("text"), _reason(c, df.schema[c.column].dataType).alias("reason"))
        found.append(F.when(lost, value))
    seen, path = Observation(), shared_dir(spark, "conformed")
    # The observation needs the source columns, so it stands before the projection.
    columns = [F.col(names[c]).alias(c) if c in names else quoted(c) for c in df.columns]
    out = wide.observe(seen, *aggs).select(*columns, F.array_compact(F.array(*found)).alias("_rejects"))
    out.write.parquet(path)
    stored = spark.read.schema(out.schema).parquet(path)
    counts = seen.get
    rows = [(c.column, c.kind, counts[f"v{i}"], counts[f"l{i}"]) for i, c in enumerate(casts)]
    rejects = stored.filter(F.size("_rejects") > 0).select(*[quoted(k) for k in keys], F.explode("_rejects").alias("_r")).select(*[quoted(k) for k in keys], "_r.*")
    return Conformed(stored.drop("_rejects"), rejects, spark.createDataFrame(rows, "column string, kind string, values long, new_nulls long"))


def identifier_collisions(catalog: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Names that differ only in case and would fold into one."""
    return (
        catalog.select(*by, name)
        .distinct()
        .groupBy(*by, F.lower(name).alias("folded"))
        .agg(F.count(name).alias("spellings"), F.min(name).alias("first_name"), F.max(name).alias("last_name"))
        .filter("spellings > 1")
    )
