from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from twinproof.functions import scalars as S
from twinproof.functions.ordered import with_previous, with_running_count
from twinproof.operators import monitor as M


def one(spark, column, **values):
    """Value of an expression over a single row of literals."""
    ddl = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], ddl)
    return df.select(column.alias("x")).first()["x"]


# --- ordered helpers ----------------------------------------------------------------------------


def series(spark, n=3000, hot=0.6):
    """A series that holds most samples, one with gaps, and small ones."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        s = "hot" if rng.random() < hot else rng.choice(["a", "b", None])
        if s == "a" and i // 100 % 3 == 1:
            continue
        rows.append((s, i * i, rng.choice([None, 1, 2, 3]), rng.random() < 0.4))
    return spark.createDataFrame(rows, "s string, ord int, v int, ok boolean").repartition(6)


@pytest.mark.parametrize("cuts", [1, 2, 3, 64])
def test_previous_equals_the_plain_window(spark, cuts):
    df = series(spark)
    got = with_previous(df, ["s"], "ord", ["v", "ok"], cuts)
    w = Window.partitionBy("s").orderBy("ord")
    want = df.withColumn("prev_v", F.lag("v").over(w)).withColumn("prev_ok", F.lag("ok").over(w)).withColumn(
        "has_prev", F.lag("ord").over(w).isNotNull()
    )
    cols = ["s", "ord", "v", "prev_v", "prev_ok", "has_prev"]
    assert {tuple(r) for r in got.select(cols).collect()} == {tuple(r) for r in want.select(cols).collect()}


@pytest.mark.parametrize("cuts", [1, 2, 3, 64])
def test_running_count_equals_the_plain_window(spark, cuts):
    df = series(spark)
    got = with_running_count(df, ["s"], "ord", F.col("ok"), "c", cuts)
    w = Window.partitionBy("s").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("c", F.sum(F.col("ok").cast("int")).over(w))
    assert {tuple(r) for r in got.select("s", "ord", "c").collect()} == {tuple(r) for r in want.select("s", "ord", "c").collect()}


# --- positions and verdicts ---------------------------------------------------------------------


def test_lsn(spark):
    assert int(one(spark, S.lsn_position(F.col("l")), l=("string", "16/B374D848"))) == 0x16 * 2**32 + 0xB374D848
    assert int(one(spark, S.lsn_position(F.col("l")), l=("string", "FFFFFFFF/FFFFFFFF"))) == 2**64 - 1


def test_binlog_positions_order(spark):
    df = spark.createDataFrame([("bin.000002:4",), ("bin.000001:900",), ("bin.000001:1000",)], "p string")
    assert [r["p"] for r in df.orderBy(S.binlog_position(F.col("p"))).collect()] == ["bin.000001:900", "bin.000001:1000", "bin.000002:4"]


def test_binary_position(spark):
    assert one(spark, S.binary_position(F.col("b")), b=("binary", bytearray(b"\x0a\xff"))) == "0aff"
    assert one(spark, S.binary_position(F.col("b")), b=("binary", None)) == "NULL"


@pytest.mark.parametrize(
    "elapsed, retention, warn, want",
    [
        (100, None, 0.8, "ok"), (100, 0, 0.8, "ok"), (100, -1, 0.8, "ok"), (79, 100, 0.8, "ok"), (80, 100, 0.8, "warn"),
        (100, 100, 0.8, "abort"), (200, 100, 0.8, "abort"), (50, 100, 0.5, "warn"),
    ],
)
def test_retention(spark, elapsed, retention, warn, want):
    expr = S.retention_verdict(F.col("e"), F.col("r"), warn)
    assert one(spark, expr, e=("bigint", elapsed), r=("bigint", retention)) == want


@pytest.mark.parametrize(
    "mb, status, want",
    [(10, "reserved", "ok"), (10, "extended", "ok"), (10, "unreserved", "warn"), (10, None, "warn"), (2049, "reserved", "abort"), (2048, "reserved", "ok"), (0, "lost", "abort")],
)
def test_retained(spark, mb, status, want):
    expr = S.retained_verdict(F.col("b"), F.col("s"))
    assert one(spark, expr, b=("bigint", mb * S.MEGABYTE), s=("string", status)) == want


@pytest.mark.parametrize(
    "body, want",
    [
        ('{"status":"UP","checks":[{"name":"debezium","status":"UP"}]}', (True, True)),
        ('{"status":"UP","checks":[{"name":"debezium","status":"DOWN"}]}', (True, False)),
        ('{"status":"UP"}', (True, True)),
        ('{"status":"DOWN","checks":[{"name":"other","status":"UP"}]}', (False, False)),
        ('{"status":"UP","checks":"odd"}', None),
        ("<html>502</html>", (False, False)),
        ("", (False, False)),
    ],
)
def test_health(spark, body, want):
    up, named = S.health_is_up(F.col("b"))
    got = (one(spark, up, b=("string", body)), one(spark, named, b=("string", body)))
    assert want is None or got == want


def test_lag_is_clamped(spark):
    assert one(spark, S.clamp(F.col("n")), n=("bigint", -5)) == 0
    assert one(spark, S.megabytes(F.col("n")), n=("bigint", 3 * S.MEGABYTE // 2)) == 2


# --- roll-ups and gates -------------------------------------------------------------------------


def test_ready_needs_a_table(spark):
    states = spark.createDataFrame([("a", "r"), ("a", "r"), ("b", "r"), ("b", "d")], "subscription string, state string")
    got = {r["subscription"]: (r["total"], r["copying"], r["all_ready"]) for r in M.sync_rollup(states).collect()}
    assert got == {"a": (2, 0, True), "b": (2, 1, False)}
    assert M.sync_rollup(states.filter("false"), []).first()["all_ready"] is False


def test_copy_progress_without_expectation(spark):
    want = spark.createDataFrame([("a", 0), ("b", 200)], "subscription string, bytes bigint")
    have = spark.createDataFrame([("b", 99)], "subscription string, bytes bigint")
    got = {r["subscription"]: r["percent"] for r in M.copy_progress(want, have).collect()}
    assert got == {"a": None, "b": 50}


def test_first_sample_never_rises(spark):
    df = spark.createDataFrame([("s", 0, 1, 9), ("s", 0, 2, 9), ("s", 1, 3, 10), ("s", 1, 4, 2)], "s string, c int, o int, n int")
    got = [r["rising"] for r in M.rising(df, ["n"], "s", "o").orderBy("o").collect()]
    assert got == [False, False, True, False]


def test_streaks(spark):
    oks = [0, 0, 1, 0, 0, 0, 0, 0, 1, 0]
    df = spark.createDataFrame([("s", i // 3, i, bool(v)) for i, v in enumerate(oks)], "s string, c int, o int, ok boolean")
    got = {(r["first"], r["last"], r["failures"], r["aborts"]) for r in M.failure_streaks(df, "s", "o").collect()}
    assert got == {(0, 1, 2, False), (3, 7, 5, True), (9, 9, 1, False)}


def test_collapse_repeats_keeps_nulls_and_returns(spark):
    lines = ["a", "a", None, None, "a", "b"]
    df = spark.createDataFrame([("s", i // 2, i, v) for i, v in enumerate(lines)], "s string, c int, o int, line string")
    assert [r["o"] for r in M.collapse_repeats(df, "line", "s", "o").orderBy("o").collect()] == [0, 2, 4, 5]


def test_write_stop(spark):
    df = spark.createDataFrame([("moving", 100), ("moving", 200), ("still", 500), ("still", 500), ("once", 1)], "src string, p bigint")
    got = {r["src"]: r["stopped"] for r in M.write_stop_gate(df, "src", "p").collect()}
    assert got == {"moving": False, "still": True, "once": False}


def test_drain_fails_closed(spark):
    want = spark.createDataFrame([("ok",), ("late",), ("silent",)], "src string")
    seen = spark.createDataFrame([("ok", 1, 5), ("ok", 2, 0), ("late", 99, 0)], "src string, o int, lag_bytes bigint")
    got = {r["src"]: (r["drained"], r["drained_at"], r["samples"]) for r in M.lag_drain(want, seen, "src", "o", F.lit(10)).collect()}
    assert got == {"ok": (True, 2, 2), "late": (False, None, 1), "silent": (False, None, 0)}


def test_sync_watch(spark):
    ddl = "s string, c int, o int, tables int, ready int, workers int"
    rows = [("done", 0, 1, 2, 0, 0), ("done", 0, 2, 2, 2, 1)]
    rows += [("empty", o // 2, o, 0, 0, 1) for o in range(1, 7)]
    rows += [("late", 0, 1, 1, 0, 1), ("late", 9, 50, 1, 0, 0)]
    got = {r["s"]: (r["outcome"], r["no_worker"], r["no_tables"]) for r in M.sync_watch(spark.createDataFrame(rows, ddl), "s", "o", F.lit(20)).collect()}
    assert got == {"done": ("done", 0, 0), "empty": ("waiting", 0, 2), "late": ("timeout", 1, 0)}


def test_health_watch(spark):
    up = '{"status":"UP"}'
    rows = [("fine", 0, 1, up), ("fine", 0, 2, None), ("fine", 1, 3, up)]
    rows += [("gone", i // 2, i, None) for i in range(5)] + [("bad", 0, 1, "<html>")]
    df = spark.createDataFrame(rows, "s string, c int, o int, body string")
    got = {r["s"]: (r["verdict"], r["longest_outage"]) for r in M.health_watch(df, "s", "o").collect()}
    assert got == {"fine": ("ok", 1), "gone": ("unreachable", 5), "bad": ("connector down", 0)}


def test_cutover_gate_needs_everything(spark):
    names = ["all", "unsigned", "moving", "counts", "position", "absent", "unknown"]
    signed = spark.createDataFrame([(n, n != "unsigned") for n in names], "src string, signed_off boolean")
    stops = spark.createDataFrame([(n, n != "moving") for n in names if n != "absent"], "src string, stopped boolean")
    counts = spark.createDataFrame(
        [(n, 5, 4 if n == "counts" else 5, 10, 9 if n == "position" else 10) for n in names] + [("unknown", 5, None, 10, 10)],
        "src string, source_rows int, target_rows int, source_pos int, applied_pos int",
    )
    got = {r["src"]: r["pass"] for r in M.cutover_gate(signed, stops, counts, "src").collect()}
    assert got == {n: n == "all" for n in names}


def test_phases():
    assert M.phases_through("watch") == ["preflight", "replicate", "watch"]
    assert M.phases_through("cutover") == list(M.PHASES)
    with pytest.raises(ValueError):
        M.phases_through("nowhere")


def test_phase_summary(spark):
    rows = [("good", p, True, 10) for p in M.PHASES]
    rows += [("broke", "preflight", True, 1), ("broke", "replicate", False, 2), ("broke", "watch", True, 4)]
    rows += [("denied", p, True, 10) for p in M.PHASES]
    rows += [("silent", p, None if p == "replicate" else True, 10) for p in M.PHASES]
    df = spark.createDataFrame(rows, "run string, phase string, ok boolean, ms bigint")
    out = M.phase_summary(df, "run", confirmed=F.col("run") != "denied")
    got = {r["run"]: (r["phases_ok"], r["failed_phase"], r["total_ms"], r["ok"]) for r in out.collect()}
    assert got == {"good": (5, None, 50, True), "broke": (1, "replicate", 3, False), "denied": (0, "unconfirmed", 0, False), "silent": (1, "replicate", 20, False)}
    early = {r["run"]: r["ok"] for r in M.phase_summary(df, "run", "preflight").collect()}
    assert early == {"good": True, "broke": True, "denied": True, "silent": True}
    assert M.stop_at_failure(df, "run").filter("run = 'broke'").count() == 2
