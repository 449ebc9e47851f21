from __future__ import annotations

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from twinproof.operators import conform as T
from twinproof.operators import faults, loadgen
from twinproof.functions.scalars import tokens, wildcards_regex

MY = (
    "column_name string, data_type string, column_type string, is_nullable string, extra string, "
    "character_maximum_length bigint, numeric_precision int, numeric_scale int, datetime_precision int"
)
MS = (
    "column_name string, data_type string, is_nullable string, character_maximum_length bigint, numeric_precision int, "
    "numeric_scale int, datetime_precision int, is_identity int, is_computed int"
)


@pytest.mark.parametrize(
    "dtype, ctype, extra, length, precision, scale, fraction, want, note",
    [
        ("tinyint", "tinyint(1)", "", None, None, None, None, "boolean", T.NOTE_TINYINT),
        ("tinyint", "tinyint(4)", "", None, None, None, None, "smallint", None),
        ("smallint", "smallint unsigned", "", None, None, None, None, "integer", None),
        ("int", "int unsigned", "", None, None, None, None, "bigint", T.NOTE_UNSIGNED_INT),
        ("int", "int", "auto_increment", None, None, None, None, "integer", None),
        ("bigint", "bigint unsigned", "", None, None, None, None, "numeric", T.NOTE_UNSIGNED_BIG),
        ("decimal", "decimal(10,2)", "", None, 10, 2, None, "numeric(10,2)", None),
        ("bit", "bit(1)", "", None, None, None, None, "boolean", None),
        ("bit", "bit(8)", "", None, None, None, None, "bit varying", T.NOTE_BITS),
        ("varchar", "varchar(40)", "", 40, None, None, None, "varchar(40)", None),
        ("datetime", "datetime(6)", "", None, None, None, 6, "timestamptz(6)", T.NOTE_DATETIME),
        ("datetime", "datetime(3)", "", None, None, None, None, "timestamptz(3)", T.NOTE_DATETIME),
        ("timestamp", "timestamp", "", None, None, None, 0, "timestamptz", None),
        ("set", "set('a','b')", "", None, None, None, None, "text", T.NOTE_SET),
        ("enum", "enum('a')", "VIRTUAL GENERATED", None, None, None, None, "text", T.NOTE_ENUM + "; " + T.NOTE_GENERATED),
        ("int", "int", "STORED GENERATED", None, None, None, None, "integer", T.NOTE_GENERATED),
        ("geomcollection", "geomcollection", "", None, None, None, None, "text", T.NOTE_SPATIAL),
        ("mystery", "mystery", "", None, None, None, None, "text", T.NOTE_UNMAPPED),
        ("JSON", "json", None, None, None, None, None, "jsonb", None),
    ],
)
def test_mysql_types(spark, dtype, ctype, extra, length, precision, scale, fraction, want, note):
    df = spark.createDataFrame([("c", dtype, ctype, "YES", extra, length, precision, scale, fraction)], MY)
    r = T.translate_mysql(df).first()
    assert (r["target_type"], r["review"]) == (want, note)


@pytest.mark.parametrize(
    "dtype, length, precision, scale, fraction, identity, computed, want, note",
    [
        ("tinyint", None, None, None, None, 0, 0, "smallint", None),
        ("datetime2", None, None, None, 7, 0, 0, "timestamp(6)", T.NOTE_FRACTION),
        ("datetime2", None, None, None, 3, 0, 0, "timestamp(3)", T.NOTE_DATETIME),
        ("datetimeoffset", None, None, None, 7, 0, 0, "timestamptz(6)", T.NOTE_FRACTION),
        ("time", None, None, None, 0, 0, 0, "time", None),
        ("datetime", None, None, None, 3, 0, 0, "timestamp", T.NOTE_DATETIME),
        ("nvarchar", -1, None, None, None, 0, 0, "text", None),
        ("nvarchar", 50, None, None, None, 0, 0, "varchar(50)", None),
        ("char", None, None, None, None, 0, 0, "char(1)", None),
        ("rowversion", None, None, None, None, 0, 0, "bytea", T.NOTE_ROWVERSION),
        ("money", None, 19, 4, None, 0, 0, "numeric(19,4)", None),
        ("int", None, 10, 0, None, 1, 0, "integer", T.NOTE_IDENTITY),
        ("int", None, 10, 0, None, 1, 1, "integer", T.NOTE_COMPUTED),
        ("xml", None, None, None, None, 0, 1, "xml", T.NOTE_XML + "; " + T.NOTE_COMPUTED),
        ("uniqueidentifier", None, None, None, None, 0, 0, "uuid", None),
        ("vector", None, None, None, None, 0, 0, "text", T.NOTE_UNMAPPED),
    ],
)
def test_sqlserver_types(spark, dtype, length, precision, scale, fraction, identity, computed, want, note):
    df = spark.createDataFrame([("c", dtype, "YES", length, precision, scale, fraction, identity, computed)], MS)
    r = T.translate_sqlserver(df).first()
    assert (r["target_type"], r["review"]) == (want, note)


def test_create_table(spark):
    ddl = "db string, table_name string, ordinal int, column_name string, target_type string, is_nullable string, key_position int"
    rows = [("d", "t", 2, "b", "text", "YES", 1), ("d", "t", 1, 'a"x', "integer", "NO", 2), ("d", "u", 1, "z", "text", "YES", None)]
    got = {r["table_name"]: r["ddl"] for r in T.create_tables(spark.createDataFrame(rows, ddl), ["db"]).collect()}
    assert got["t"] == (
        'CREATE TABLE IF NOT EXISTS "public"."t" (\n  "a""x" integer NOT NULL,\n  "b" text,\n  PRIMARY KEY ("b", "a""x")\n);'
    )
    assert got["u"] == 'CREATE TABLE IF NOT EXISTS "public"."u" (\n  "z" text\n);'


def test_sign_off_resets_when_the_draft_changes(spark):
    ddl = "db string, table_name string, column_name string, target_type string, review string"
    first = spark.createDataFrame([("a", "t", "x", "text", "n"), ("b", "t", "x", "text", "n"), ("c", "t", "x", "text", None), ("d", "t", "x", "text", "n")], ddl)
    # As many decisions as before, but another type or another note.
    again = spark.createDataFrame([("a", "t", "x", "text", "n"), ("b", "t", "x", "bytea", "n"), ("c", "t", "x", "text", None), ("d", "t", "x", "text", "m")], ddl)
    approvals = T.manifest(first.filter("db <> 'c'"), ["db"])
    got = {r["db"]: r["signed_off"] for r in T.sign_off(T.manifest(again, ["db"]), approvals, ["db"]).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}


def test_guarded_casts_equal_try_cast(spark):
    values = ["1", " 2 ", "+3", "-4.5", "1e3", "x", "", None, "32767", "32768", "-32769", "9e99", "NaN", "Infinity", ".5", "5.", "1,2", "0x1F"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for to in ("smallint", "bigint", "decimal(5,2)", "double"):
        got = T.conform_rows(df, [T.Cast("v", "cast", to)]).collect()
        assert [str(r.v) for r in got] == [str(r.v) for r in df.select(F.col("v").try_cast(to).alias("v")).collect()], to
    numbers = [0.0, -0.5, 127.9, 128.0, -128.9, -129.0, 32767.5, 32768.0, 2.0**64, -(2.0**63), 1e300, float("nan"), None]
    for kind in ("double", "bigint", "decimal(38,1)"):
        rows = df.sparkSession.createDataFrame([(v,) for v in numbers], "v double").select(F.col("v").try_cast(kind).alias("v"))
        for to in ("tinyint", "smallint", "int", "bigint"):
            got = T.conform_rows(rows, [T.Cast("v", "cast", to)]).collect()
            assert got == rows.select(F.col("v").try_cast(to).alias("v")).collect(), (kind, to)


def test_conform(spark):
    df = spark.createDataFrame(
        [(1, "18446744073709551615", 1, "0000-00-00", "a,b", "12:30:00.1234567"), (2, "x", 0, "2024-02-29", "", None), (3, None, None, None, None, None)],
        "id int, big string, flag int, day string, tags string, t string",
    )
    casts = [T.Cast("big", "cast", "decimal(20,0)"), T.Cast("flag", "bool"), T.Cast("day", "zero_date"), T.Cast("tags", "set")]
    got = {r["id"]: r for r in T.conform_rows(df, casts).collect()}
    assert got[1]["big"] == decimal.Decimal(2**64 - 1) and got[1]["flag"] is True and got[1]["day"] is None and got[1]["tags"] == ["a", "b"]
    assert got[2]["big"] is None and got[2]["day"] == datetime.date(2024, 2, 29) and got[2]["tags"] == [] and got[3]["tags"] is None
    rep = {r["column"]: (r["values"], r["new_nulls"]) for r in T.conform_report(df, casts).collect()}
    assert rep == {"big": (2, 1), "flag": (2, 0), "day": (2, 1), "tags": (2, 0)}
    assert [r[0] for r in T.conform_rows(df.select("id", "t"), [T.Cast("t", "time")]).orderBy("id").select("t").collect()] == ["12:30:00.123456", None, None]
    with pytest.raises(ValueError):
        T.conform_expr(T.Cast("x", "odd"))


def test_collisions(spark):
    df = spark.createDataFrame([("s", "Users"), ("s", "users"), ("s", "users"), ("s", "b")], "s string, n string")
    got = [tuple(r) for r in T.identifier_collisions(df, ["s"], "n").collect()]
    assert got == [("s", "users", 2, "Users", "users")]


def test_wildcards(spark):
    import re

    rx = re.compile(wildcards_regex(["auth", "timescaledb_*"]))
    assert rx.match("auth") and rx.match("timescaledb_x") and not rx.match("authx") and not rx.match("_timescaledb_x")


# --- load ---------------------------------------------------------------------------------------


def test_seed_is_deterministic_and_sized(spark):
    a = loadgen.seed_rows(spark.range(100), "id", 330)
    assert a.exceptAll(loadgen.seed_rows(spark.range(100).repartition(7), "id", 330)).count() == 0
    assert a.select(F.length("content")).first()[0] == 10 * 33 - 1
    assert a.select("content").distinct().count() == 100


def test_seed_to_size(spark, tmp_path):
    path = str(tmp_path / "seed")
    n = loadgen.seed_to_size(spark, path, 2_000_000, 1_000, 200)
    size = sum(f.stat().st_size for f in (tmp_path / "seed").glob("*.parquet"))
    df = spark.read.parquet(path)
    assert df.count() == n == df.select("id").distinct().count()
    assert 0.8 < size / 2_000_000 < 1.3


def test_load_ratios(spark):
    ch = loadgen.mixed_changes(spark.range(20_000), "id")
    by = {r["op"]: r["count"] for r in ch.groupBy("op").count().collect()}
    assert by["c"] == 20_000 and abs(by["u"] / 20_000 - 0.2) < 0.02 and abs(by["d"] / 20_000 - 0.3 * 0.15) < 0.01
    assert abs(ch.filter("op = 'c' AND tracked").count() / 20_000 - 0.7) < 0.02
    assert ch.filter("op = 'd' AND tracked").count() == 0
    assert ch.select("pos").distinct().count() == ch.count()


def test_adversarial_shapes(spark):
    ids = spark.range(1, 2000)
    docs = loadgen.documents(ids, "id", 50)
    assert docs.filter("title IS NULL").count() == 1999 // 9 and docs.filter("ratio IS NULL").count() == 1999 // 5
    assert docs.schema["search_vector"].metadata == {"generated": True}
    users = loadgen.users(ids, "id")
    assert users.filter("display_name IS NULL").count() == 1999 // 7
    assert users.filter("n = 2").first()["balance"] == decimal.Decimal("2.46913578")
    assert loadgen.audit(ids, "id").filter("detail IS NULL").count() == 1999 // 3
    assert loadgen.identity_rows(ids, "id").count() == 199


def test_tokens(spark):
    df = spark.createDataFrame([("Ab ab, C-d! 日本",), (None,)], "t string")
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()] == [["ab", "c", "d", "日本"], []]


def test_extra_rows_never_meet_real_keys(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    yes, no = F.col("k") >= 0, F.col("k") < 0
    out = faults.skewed_copy(df, "k", "v", no, no, yes)
    assert out.count() == 2000 and out.select("k").distinct().count() == 2000
