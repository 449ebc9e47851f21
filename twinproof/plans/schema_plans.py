"""Catalog, type-mapping and row-conformance queries.

Parts are read as catalog columns, eight to a table; lines of orders as raw source rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.operators import conform as T
from twinproof.operators.inventory import own_schemas
from twinproof.operators.profile import category_of_name
from twinproof.plans.registry import Derived, pick, query, with_ctes
from twinproof.session import shared_dir
from twinproof.sources import catalog as C
from twinproof.sources.reports import read_report, write_draft, write_report

# (data type, column type, length, precision, scale, fraction) per cycle step.
_MYSQL = [
    ("tinyint", "tinyint(1)"), ("tinyint", "tinyint unsigned"), ("smallint", "smallint unsigned"), ("SMALLINT", "smallint"),
    ("mediumint", "mediumint"), ("int", "int unsigned"), ("int", "int"), ("bigint", "bigint unsigned"), ("bigint", "bigint"),
    ("decimal", "decimal(10,2)"), ("float", "float"), ("double", "double"), ("bit", "bit(1)"), ("bit", "bit(8)"),
    ("char", "char(3)"), ("varchar", "varchar(255)"), ("text", "text"), ("longblob", "longblob"), ("date", "date"),
    ("datetime", "datetime(6)"), ("datetime", "datetime"), ("timestamp", "timestamp(3)"), ("time", "time(2)"), ("year", "year"),
    ("enum", "enum('a')"), ("set", "set('a','b')"), ("json", "json"), ("polygon", "polygon"), ("vector", "vector(3)"),
]
_MYSQL_TARGET = [
    "boolean", "smallint", "integer", "smallint", "integer", "bigint", "integer", "numeric", "bigint", "numeric(P,S)", "real",
    "double precision", "boolean", "bit varying", "char(N)", "varchar(N)", "text", "bytea", "date", "timestamptz(6)",
    "timestamptz", "timestamptz(3)", "time(2)", "smallint", "text", "text", "jsonb", "text", "text",
]
_MYSQL_NOTE = [
    T.NOTE_TINYINT, None, None, None, None, T.NOTE_UNSIGNED_INT, None, T.NOTE_UNSIGNED_BIG, None, None, None, None, None,
    T.NOTE_BITS, None, None, None, None, None, T.NOTE_DATETIME, T.NOTE_DATETIME, None, None, T.NOTE_YEAR, T.NOTE_ENUM,
    T.NOTE_SET, None, T.NOTE_SPATIAL, T.NOTE_UNMAPPED,
]
_COMMON = {
    "database": "p_brand",
    "table_name": "'t' || (p_partkey DIV 8)",
    "ordinal": "p_partkey % 8 + 1",
    "column_name": "'c' || p_partkey || CASE WHEN p_partkey % 40 = 0 THEN '\"q' ELSE '' END",
    "is_nullable": "CASE WHEN p_partkey % 3 = 0 THEN 'NO' ELSE 'YES' END",
    "character_maximum_length": "CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 9 = 1 THEN -1 ELSE p_size END",
    "numeric_precision": "CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size % 38 + 1 END",
    "numeric_scale": "CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size % 2 END",
    "key_position": "CASE WHEN p_partkey % 8 = 5 THEN 1 WHEN p_partkey % 8 = 2 AND p_size % 2 = 0 THEN 2 END",
}
MYSQL = Derived(
    "mysql",
    "part",
    {
        "id": "p_partkey",
        **_COMMON,
        "data_type": pick("p_partkey", [a for a, _ in _MYSQL]),
        "column_type": pick("p_partkey", [b for _, b in _MYSQL]),
        "extra": "CASE WHEN p_size % 10 = 0 THEN 'STORED GENERATED' WHEN p_size % 10 = 1 THEN 'auto_increment' END",
        "datetime_precision": "CASE WHEN p_size % 2 = 0 THEN NULL ELSE 0 END",
    },
)
_STEP = f"(id % {len(_MYSQL)})"


def _filled(case: str, length: str) -> str:
    out = f"replace({case}, 'N', CAST({length} AS VARCHAR))"
    out = f"replace({out}, 'P', CAST(coalesce(numeric_precision, 38) AS VARCHAR))"
    return f"replace({out}, 'S', CAST(coalesce(numeric_scale, 0) AS VARCHAR))"


_MYSQL_SQL = with_ctes(MYSQL) + f""", tr AS (SELECT *,
  {_filled(pick("id", _MYSQL_TARGET), f"coalesce(character_maximum_length, CASE WHEN data_type = 'char' THEN 1 ELSE 255 END)")} AS target_type,
  nullif(concat_ws('; ', {pick("id", _MYSQL_NOTE)}, CASE WHEN extra LIKE '%GENERATED%' THEN '{T.NOTE_GENERATED}' END), '') AS review FROM mysql) """


@query("translate_mysql", _MYSQL_SQL + "SELECT id, column_type, target_type, review FROM tr")
def translate_mysql(spark: SparkSession, folder: str) -> DataFrame:
    return T.translate_mysql(MYSQL.df(spark, folder)).select("id", "column_type", "target_type", "review")


_MSSQL = [
    "tinyint", "smallint", "int", "bigint", "bit", "numeric", "money", "smallmoney", "float", "real", "date", "time",
    "smalldatetime", "datetime2", "datetimeoffset", "nchar", "nvarchar", "ntext", "image", "uniqueidentifier", "xml",
    "rowversion", "hierarchyid", "geography", "sql_variant", "vector",
]
_MSSQL_TARGET = [
    "smallint", "smallint", "integer", "bigint", "boolean", "numeric(P,S)", "numeric(19,4)", "numeric(10,4)",
    "double precision", "real", "date", "timeF", "timestamp", "timestampF", "timestamptzF", "char(N)", "varchar(N)", "text",
    "bytea", "uuid", "xml", "bytea", "text", "text", "text", "text",
]
_MSSQL_NOTE = [
    *[None] * 11, "F", T.NOTE_DATETIME, "F?" + T.NOTE_DATETIME, "F", None, None, None, None, None, T.NOTE_XML, T.NOTE_ROWVERSION,
    T.NOTE_NO_EQUIVALENT, T.NOTE_SPATIAL, T.NOTE_NO_EQUIVALENT, T.NOTE_UNMAPPED,
]
MSSQL = Derived(
    "mssql",
    "part",
    {
        "id": "p_partkey",
        **_COMMON,
        "data_type": pick("p_partkey", _MSSQL),
        "datetime_precision": "CASE WHEN p_size % 8 = 0 THEN NULL ELSE p_size % 8 END",
        "is_computed": "CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END",
        "is_identity": "CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END",
    },
)
_FRACTION = "CASE WHEN coalesce(datetime_precision, 0) = 0 THEN '' ELSE '(' || least(datetime_precision, 6) || ')' END"
_MS_LENGTH = "CASE WHEN coalesce(character_maximum_length, 0) > 0 THEN character_maximum_length WHEN data_type = 'nchar' THEN 1 ELSE 255 END"
_CUT = "coalesce(datetime_precision, 0) > 6"
_MSSQL_SQL = with_ctes(MSSQL) + f""", tr AS (SELECT *,
  CASE WHEN data_type = 'nvarchar' AND character_maximum_length = -1 THEN 'text'
    ELSE replace({_filled(pick("id", _MSSQL_TARGET), _MS_LENGTH)}, 'F', {_FRACTION}) END AS target_type,
  {pick("id", _MSSQL_NOTE)} AS raw FROM mssql),
  tn AS (SELECT *, nullif(concat_ws('; ', CASE WHEN raw LIKE 'F%' AND {_CUT} THEN '{T.NOTE_FRACTION}' WHEN raw = 'F' THEN NULL
    WHEN raw LIKE 'F?%' THEN substr(raw, 3) ELSE raw END,
    CASE WHEN is_computed = 1 THEN '{T.NOTE_COMPUTED}' WHEN is_identity = 1 THEN '{T.NOTE_IDENTITY}' END), '') AS review FROM tr) """


@query("translate_sqlserver", _MSSQL_SQL + "SELECT id, data_type, target_type, review FROM tn")
def translate_sqlserver(spark: SparkSession, folder: str) -> DataFrame:
    return T.translate_sqlserver(MSSQL.df(spark, folder)).select("id", "data_type", "target_type", "review")


@query(
    "schema_draft",
    _MYSQL_SQL
    + """, d AS (SELECT "database", table_name, string_agg('  "' || replace(column_name, '"', '""') || '" ' || target_type ||
        CASE WHEN is_nullable = 'YES' THEN '' ELSE ' NOT NULL' END, chr(44) || chr(10) ORDER BY ordinal) AS body,
      string_agg('"' || replace(column_name, '"', '""') || '"', ', ' ORDER BY key_position) FILTER (WHERE key_position IS NOT NULL) AS keys
      FROM tr GROUP BY 1, 2)
    SELECT "database", table_name, 'CREATE TABLE IF NOT EXISTS "public"."' || table_name || '" (' || chr(10) || body ||
      coalesce(',' || chr(10) || '  PRIMARY KEY (' || keys || ')', '') || chr(10) || ');' AS ddl FROM d""",
)
def schema_draft(spark: SparkSession, folder: str) -> DataFrame:
    """CREATE TABLE text per database and table."""
    return T.create_tables(T.translate_mysql(MYSQL.df(spark, folder)), ["database"])


@query(
    "schema_files",
    _MYSQL_SQL + "SELECT count(DISTINCT (\"database\", table_name)) AS tables, count(review) AS decisions FROM tr",
)
def schema_files(spark: SparkSession, folder: str) -> DataFrame:
    """The review files of a draft: DDL text and decisions, counted after reading them back."""
    translated = T.translate_mysql(MYSQL.df(spark, folder))
    path = shared_dir(spark, "draft")
    write_draft(T.create_tables(translated, ["database"]), T.decisions(translated), path)
    tables = spark.read.text(f"{path}/ddl").agg(F.count_if(F.col("value").startswith("CREATE TABLE")).alias("tables"))
    return tables.withColumn("decisions", read_report(spark, f"{path}/decisions", "review string").agg(F.count("review")).scalar())


@query("schema_decisions", _MYSQL_SQL + 'SELECT "database", table_name, column_name, column_type, extra, review FROM tr WHERE review IS NOT NULL')
def schema_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Open decisions with the source's own type text and attributes, through the JSON-lines sink."""
    found = T.decisions(T.translate_mysql(MYSQL.df(spark, folder)))
    found = found.select("database", "table_name", "column_name", "column_type", "extra", "review")
    return read_report(spark, write_report(found, shared_dir(spark, "decisions")), found.schema)


def _line(kind: str, key: str, null: str) -> str:
    """Checksum of a draft's line: its parts, each with its length."""
    parts = ["table_name", "column_name", kind, "review", "CAST(ordinal AS VARCHAR)", f"CAST({key} AS VARCHAR)", null]
    text = " || ".join(f"coalesce(length({p}) || ':' || {p}, '-')" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"


@query(
    "schema_sign_off",
    _MYSQL_SQL
    + f""", l AS (SELECT *, CASE WHEN id % 64 = 0 THEN 'text' ELSE target_type END AS was,
      CASE WHEN upper(is_nullable) = 'YES' THEN 'null' ELSE 'not null' END AS nn,
      CASE WHEN id % 96 = 1 THEN 'null' WHEN upper(is_nullable) = 'YES' THEN 'null' ELSE 'not null' END AS nn_was,
      CASE WHEN id % 80 = 2 THEN NULL ELSE key_position END AS key_was FROM tr),
    s AS (SELECT *, {_line("target_type", "key_position", "nn")} AS line, {_line("was", "key_was", "nn_was")} AS old_line FROM l)
    SELECT "database", CAST(sum(line) AS VARCHAR) AS draft, count(DISTINCT table_name) AS tables, count(*) AS columns, count(review) AS decisions,
      sum(line) = sum(old_line) AS signed_off FROM s GROUP BY 1""",
)
def schema_sign_off(spark: SparkSession, folder: str) -> DataFrame:
    """Draft manifests; the approvals were given for an older draft, in which some columns had another type, key place or NOT NULL."""
    translated = T.translate_mysql(MYSQL.df(spark, folder))
    older = translated.withColumns({
        "target_type": F.when(F.col("id") % 64 == 0, "text").otherwise(F.col("target_type")),
        "is_nullable": F.when(F.col("id") % 96 == 1, "YES").otherwise(F.col("is_nullable")),
        "key_position": F.when(F.col("id") % 80 != 2, F.col("key_position")),
    })
    return T.sign_off(T.manifest(translated, ["database"]), T.manifest(older, ["database"]), ["database"])


_TYPE_NAMES = ["integer", "interval", "double precision", "uuid", "timestamp with time zone", "boolean", "bytea", "bigserial", "citext", "jsonb", "int4", "money"]
_TYPE_CLASSES = ["numeric", "temporal", "numeric", "text", "temporal", "boolean", "other", "numeric", "text", "other", "numeric", "numeric"]
TYPES = Derived("types", "part", {"id": "p_partkey", "type_name": pick("p_partkey", _TYPE_NAMES)})


@query("type_category", with_ctes(TYPES) + f"SELECT id, type_name, {pick('id', _TYPE_CLASSES)} AS category FROM types")
def type_category(spark: SparkSession, folder: str) -> DataFrame:
    return TYPES.df(spark, folder).withColumn("category", category_of_name(F.col("type_name")))


COLUMNS = Derived(
    "columns",
    "part",
    {
        "table_id": "p_partkey DIV 8",
        "attnum": "p_partkey % 8 + 1",
        "column_name": "'c' || (p_partkey % 8)",
        "is_generated": "p_size % 6 = 0",
    },
)


@query("catalog_columns", with_ctes(COLUMNS) + "SELECT table_id, attnum, column_name FROM columns WHERE NOT is_generated")
def catalog_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Hashable columns of every table in a catalog dump."""
    return C.non_generated(COLUMNS.df(spark, folder)).select("table_id", "attnum", "column_name")


INDEXES = Derived(
    "indexes",
    "part",
    {
        "table_id": "p_partkey DIV 8",
        "is_primary": "p_partkey % 8 = 0 AND p_size % 2 = 0",
        "attnum_list": "CASE WHEN p_size % 3 = 0 THEN '3,1' WHEN p_size % 3 = 1 THEN '8' ELSE '2,5,4' END",
    },
)


@query(
    "catalog_keys",
    with_ctes(COLUMNS, INDEXES)
    + """, k AS (SELECT table_id, string_split(attnum_list, ',') AS l, unnest(range(1, len(string_split(attnum_list, ',')) + 1)) AS key_position
      FROM indexes WHERE is_primary)
    SELECT k.table_id, key_position, column_name FROM k JOIN columns c ON c.table_id = k.table_id AND c.attnum = CAST(l[key_position] AS BIGINT)""",
)
def catalog_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Primary-key columns in index order."""
    indexes = INDEXES.df(spark, folder).withColumn("attnums", F.split("attnum_list", ",").cast("array<bigint>"))
    return C.key_columns(indexes, COLUMNS.df(spark, folder))


LIVE = COLUMNS.but("live")
PINNED = Derived(
    "pinned",
    "part",
    {
        "table_id": "p_partkey DIV 8",
        "column_name": "CASE WHEN p_partkey % 29 = 0 THEN 'gone' || p_partkey ELSE 'c' || (p_partkey % 8) END",
    },
    where="p_type <> 'ECONOMY' AND p_size > 5",
)


@query(
    "hash_column_audit",
    with_ctes(LIVE, PINNED)
    + """, l AS (SELECT * FROM live WHERE table_id IN (SELECT table_id FROM pinned))
    SELECT coalesce(l.table_id, p.table_id) AS table_id, coalesce(l.column_name, p.column_name) AS column_name,
      CASE WHEN l.column_name IS NULL THEN 'nonexistent' WHEN p.column_name IS NULL THEN 'missing_from_pinned' ELSE 'generated_pinned' END AS finding
    FROM l FULL JOIN pinned p ON l.table_id = p.table_id AND l.column_name = p.column_name
    WHERE l.column_name IS NULL OR (p.column_name IS NULL AND NOT l.is_generated) OR (p.column_name IS NOT NULL AND l.is_generated)""",
)
def hash_column_audit(spark: SparkSession, folder: str) -> DataFrame:
    return C.hash_column_audit(LIVE.df(spark, folder).drop("attnum"), PINNED.df(spark, folder))


_SCHEMAS = ["public", "auth", "authx", "timescaledb_internal", "_timescaledb_", "graphql_public", "app", "Storage"]
_SCOPED = ["true", "false", "true", "false", "false", "false", "true", "true"]
SCHEMAS = Derived("schemas", "part", {"id": "p_partkey", "schema": pick("p_partkey", _SCHEMAS)})


@query("schema_scope", with_ctes(SCHEMAS) + f"SELECT * FROM schemas WHERE CAST({pick('id', _SCOPED)} AS BOOLEAN)")
def schema_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog rows outside the managed schemas."""
    return own_schemas(SCHEMAS.df(spark, folder))


NAMES = Derived(
    "names",
    "part",
    {"server": "p_brand", "name": "CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END"},
)


@query(
    "identifier_collisions",
    with_ctes(NAMES)
    + """SELECT server, lower(name) AS folded, count(DISTINCT name) AS spellings, min(name) AS first_name, max(name) AS last_name
    FROM names GROUP BY 1, 2 HAVING count(DISTINCT name) > 1""",
)
def identifier_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return T.identifier_collisions(NAMES.df(spark, folder), ["server"], "name")


RAW = Derived(
    "raw",
    "lineitem",
    {
        "l_orderkey": "l_orderkey",
        "l_partkey": "l_partkey",
        "l_linenumber": "l_linenumber",
        "big": "CASE WHEN l_partkey % 50 = 0 THEN '18446744073709551615' ELSE CAST(l_partkey AS STRING) END",
        "small": "CAST(l_quantity AS BIGINT) * 1000",
        "flag": "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 END",
        "day": "CASE WHEN l_linenumber = 7 THEN '0000-00-00' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END",
        "tags": "CASE l_linestatus WHEN 'O' THEN 'a,b' ELSE '' END",
        "price": "CAST(CAST(l_extendedprice AS DECIMAL(15,4)) AS STRING)",
        "at": "'12:30:0' || l_linenumber || '.' || lpad(CAST(l_suppkey AS STRING), 7, '7')",
    },
)
CASTS = [
    T.Cast("big", "cast", "decimal(20,0)"),
    T.Cast("small", "cast", "smallint"),
    T.Cast("flag", "bool"),
    T.Cast("day", "zero_date"),
    T.Cast("tags", "set"),
    T.Cast("price", "cast", "decimal(15,2)"),
    T.Cast("at", "time"),
]


@query(
    "conform_rows",
    with_ctes(RAW)
    + """SELECT l_orderkey, l_partkey, l_linenumber, CAST(CAST(big AS DECIMAL(20,0)) AS VARCHAR) AS big, CAST(TRY_CAST(small AS SMALLINT) AS INTEGER) AS small,
      CAST(flag AS BOOLEAN) AS flag, TRY_CAST(day AS DATE) AS day, CASE tags WHEN '' THEN 0 ELSE 2 END AS tag_count,
      CAST(CAST(CAST(price AS DECIMAL(15,4)) AS DECIMAL(15,2)) AS VARCHAR) AS price, left("at", 15) AS "at" FROM raw""",
)
def conform_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Raw source rows cast to the target types; impossible values become null."""
    out = T.conform_rows(RAW.df(spark, folder), CASTS)
    return out.select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.col("big").cast("string").alias("big"),
        F.col("small").cast("int").alias("small"),
        "flag",
        "day",
        F.size("tags").alias("tag_count"),
        F.col("price").cast("string").alias("price"),
        "at",
    )


@query(
    "conform_report",
    with_ctes(RAW)
    + """SELECT 'big' AS "column", 'cast' AS kind, count(big) AS "values", CAST(0 AS BIGINT) AS new_nulls FROM raw
    UNION ALL SELECT 'small', 'cast', count(small), count(*) FILTER (WHERE small > 32767) FROM raw
    UNION ALL SELECT 'flag', 'bool', count(flag), 0 FROM raw
    UNION ALL SELECT 'day', 'zero_date', count(day), count(*) FILTER (WHERE day = '0000-00-00') FROM raw
    UNION ALL SELECT 'tags', 'set', count(tags), 0 FROM raw
    UNION ALL SELECT 'price', 'cast', count(price), 0 FROM raw
    UNION ALL SELECT 'at', 'time', count("at"), 0 FROM raw""",
)
def conform_report(spark: SparkSession, folder: str) -> DataFrame:
    return T.conform_report(RAW.df(spark, folder), CASTS)
