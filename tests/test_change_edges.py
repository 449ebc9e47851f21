"""Edges of change apply: nulls, malformed images, lost checkpoints, earlier positions, chunked copies, schema history, load order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.operators import changes as C
from twinproof.operators import conform as S
from twinproof.operators import monitor as M
from twinproof.operators.history import NO_SCHEMA, SchemaHistory, Version, open_as_of
from twinproof.operators.loadorder import load_order
from twinproof.operators.reconcile import reconcile
from twinproof.streaming.apply import ChangeRouter, ChangeTable, read_landed
from twinproof.streaming.keyed import newest_changes
from twinproof.streaming.snapshot import ChunkedSnapshot

DDL = "k bigint, op string, pos bigint, v string"


def state(df):
    return {(r["k"], r["v"]) for r in df.collect()}


def make(spark, rows, ddl=DDL):
    return spark.createDataFrame(rows, ddl)


# -- change table ------------------------------------------------------------------------------------


def test_null_in_a_key_part_replaces_its_row(spark, tmp_path):
    t = ChangeTable(str(tmp_path / "t"), ("a", "b"))
    t.create(make(spark, [(1, None, "old"), (1, 2, "x")], "a int, b int, v string"), 0)
    t.write_batch(make(spark, [(1, None, "new", "u", 5), (None, None, "all null", "c", 6)], "a int, b int, v string, op string, pos bigint"), 0)
    want = {(1, None, "new"), (1, 2, "x"), (None, None, "all null")}
    for _ in range(2):
        assert {(r.a, r.b, r.v) for r in t.state(spark).collect()} == want
        t.compact(spark)
    snapshot = make(spark, [(None, "a"), (1, "b")], "k bigint, v string")
    got = C.merge(snapshot, make(spark, [(None, "u", 1, "z")]), ["k"])
    assert state(got) == {(None, "z"), (1, "b")}


def test_a_new_checkpoint_at_an_old_path_is_a_run_of_its_own(spark, tmp_path):
    t = ChangeTable(str(tmp_path / "t"), ("k",))
    t.create(make(spark, [(1, "a")], "k bigint, v string"), 0)
    for i in (1, 2):
        make(spark, [(1 + i, "c", i, f"v{i}")]).write.parquet(str(tmp_path / f"in{i}"))
        t.start(read_landed(spark, str(tmp_path / f"in{i}"), make(spark, []).schema), str(tmp_path / "o")).awaitTermination()
        t.compact(spark)
        (tmp_path / "o").rename(tmp_path / f"lost{i}")
    assert state(t.state(spark)) == {(1, "a"), (2, "v1"), (3, "v2")}


def test_a_generation_has_one_writer(spark, tmp_path):
    t = ChangeTable(str(tmp_path / "t"), ("k",))
    t.create(make(spark, [(1, "a")], "k bigint, v string"), 0)
    t.write_batch(make(spark, [(1, "u", 1, "b")]), 0)
    t._claim(spark, 1, False)  # a compaction that was lost
    with pytest.raises(RuntimeError, match="being written"):
        t.compact(spark)
    assert t.compact(spark, take_over=True) == 1 and state(t.state(spark)) == {(1, "b")}


def test_states_as_of_every_position(spark, tmp_path):
    rnd = random.Random(4)
    log = [(rnd.randrange(6), rnd.choice("cuud"), pos, f"v{pos}") for pos in range(1, 31)]
    t = ChangeTable(str(tmp_path / "t"), ("k",), history=True, buckets=4)
    t.create(make(spark, [(0, "s"), (9, "s")], "k bigint, v string"), 0)
    for i in range(0, 30, 10):
        t.write_batch(make(spark, log[i : i + 10]), i)
        if i < 20:
            t.compact(spark)

    def plain(at):
        rows = {0: "s", 9: "s"}
        for k, op, pos, v in log:
            if pos <= at:
                rows.pop(k, None)
                if op != "d":
                    rows[k] = v
        return set(rows.items())

    for at in (0, 3, 10, 14, 25, 30, 99):
        assert state(t.state(spark, as_of=at)) == plain(at)
    t.retire(spark)
    assert state(t.state(spark, as_of=25)) == plain(25)
    with pytest.raises(ValueError, match="nothing is left"):
        t.state(spark, as_of=3)
    with pytest.raises(ValueError, match="history"):
        ChangeTable(t.path, ("k",)).state(spark, as_of=3)


def test_quarantine_holds_rejected_changes_only(spark, tmp_path):
    ddl = "topic string, op string, pos bigint, before string, after string"
    rows = [
        ("d.s.t", "c", 1, None, '{"k":1,"v":"a"}'), ("d.s.t", "u", 2, None, '{"k":"x"}'), ("d.s.t", "u", 3, None, '{"k":'), ("d.s.t", "u", 4, None, '{"k":null}'),
        ("d.s.t", "u", 5, None, None), ("d.s.t", None, 6, None, '{"k":7}'), ("other", "c", 7, None, '{"k":8}'), ("d.s.t", "d", 8, '{"k":3}', None),
    ]
    columns = T.StructType.fromDDL("k bigint, v string")
    table = ChangeTable(str(tmp_path / "t"), ("k",))
    table.create(spark.createDataFrame([(3, "gone")], columns), 0)
    router = ChangeRouter({"t": table}, {"t": columns}, str(tmp_path / "q"), "d")
    for _ in range(2):  # a replay has no further effect
        router.write_batch(make(spark, rows, ddl), 0)
    assert state(table.state(spark)) == {(1, "a")}
    got = {r.pos: (r.source, r.reason) for r in router.rejected(spark, make(spark, [], ddl).schema, reasons=True).collect()}
    t = "t"
    assert got == {2: (t, C.BAD_IMAGE), 3: (t, C.BAD_IMAGE), 4: (t, C.NULL_KEY), 5: (t, C.NO_IMAGE), 6: (t, C.BAD_OP), 7: (None, "unrouted")}
    assert router.rejected(spark, make(spark, [], ddl).schema).count() == 6
    assert not list((tmp_path / "q-staging").glob("run=*/batch=*"))


def test_marks_of_any_type(spark):
    rows = make(spark, [("a", "0009"), ("a", "0010"), ("b", "0011")], "table string, pos string")
    assert [r.pos for r in C.after_high_water(rows, {"a": "0009"}).collect()] == ["0010"]


# -- keyed state -------------------------------------------------------------------------------------


def test_keyed_state_drops_what_is_not_newer_across_restarts(spark, tmp_path):
    seen = []

    def run():
        stream = newest_changes(read_landed(spark, str(tmp_path / "in"), make(spark, []).schema, files_per_batch=1), ["k"])
        q = stream.writeStream.foreachBatch(lambda b, i: seen.extend((r.k, r.pos) for r in b.collect()))
        q.outputMode("append").option("checkpointLocation", str(tmp_path / "o")).trigger(availableNow=True).start().awaitTermination()

    for rows in ([(1, "u", 5, "a"), (1, "u", 7, "b"), (2, "u", 1, "c")], [(1, "u", 6, "stale"), (2, "d", 2, None), (3, "c", None, "no position")], [(1, "u", 7, "again"), (None, "c", 1, "n")]):
        make(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    assert sorted(seen, key=str) == sorted([(1, 7), (2, 1), (2, 2), (None, 1)], key=str)


# -- chunked copies -------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunks", [1, 3, 8])
def test_chunks_equal_one_copy_for_any_size_and_order(spark, tmp_path, chunks):
    rnd = random.Random(chunks)
    rows = make(spark, [(k, "s") for k in range(0, 40, 2)], "k bigint, v string")
    log = [(rnd.randrange(44), rnd.choice("cuud"), pos, f"v{pos}") for pos in range(1, 60)]
    changes = make(spark, log)
    copy = ChunkedSnapshot(str(tmp_path / "c"), "k")
    order = list(range(copy.plan(rows, chunks)))
    rnd.shuffle(order)
    assert copy.waiting(spark) == sorted(order)
    table = ChangeTable(str(tmp_path / "t"), ("k",), buckets=4)
    with pytest.raises(ValueError, match="not read"):
        copy.into(spark, table)
    for i, chunk in enumerate([*order, order[0]]):
        low = 5 * i
        seen = C.apply_changes(rows, changes.filter(F.col("pos") <= low + rnd.randrange(6)), ["k"])
        copy.read(seen, chunk, low, low + 5)
    copy.into(spark, table)
    table.write_batch(changes, 0)
    assert state(table.state(spark)) == state(C.apply_changes(rows, changes, ["k"]))


# -- schema history ---------------------------------------------------------------------------------------


def test_images_are_opened_with_the_schema_of_their_position(spark, tmp_path):
    history = SchemaHistory(str(tmp_path / "h"))
    history.record(spark, "t", Version(100, (("k", "bigint", None), ("flag", "boolean", None), ("n", "string", None))))
    for _ in range(2):  # a replayed note replaces itself
        history.record(spark, "t", Version(10, (("k", "bigint", None), ("flag", "tinyint", "{} <> 0"))))
    versions = history.versions(spark, "t")
    assert [v.since for v in versions] == [10, 100]
    rows = [
        ("u", 50, None, '{"k":1,"flag":1}'), ("u", 100, None, '{"k":2,"flag":true,"n":"x"}'), ("u", 5, None, '{"k":3,"flag":1}'), ("u", 60, None, '{"k":4,"flag":true}'),
        ("u", 110, None, '{"flag":true}'), ("d", 70, '{"k":5,"flag":0}', None), ("u", None, None, '{"k":6}'),
    ]
    target = T.StructType.fromDDL("k bigint, flag boolean, n string")
    got = open_as_of(make(spark, rows, "op string, pos bigint, before string, after string"), versions, target, ["k"]).collect()
    assert {(r.pos, r.k, r.flag, r.n, r._reason) for r in got} == {
        (50, 1, True, None, None), (100, 2, True, "x", None), (5, None, None, None, NO_SCHEMA), (60, None, None, None, C.BAD_IMAGE),
        (110, None, None, None, C.NULL_KEY), (70, 5, False, None, None), (None, None, None, None, NO_SCHEMA),
    }


# -- load order -----------------------------------------------------------------------------------------


def test_load_order_with_cycles_self_references_and_strangers(spark):
    edges = [("b", "a"), ("c", "b"), ("c", "a"), ("c", "a"), ("d", "d"), ("x", "y"), ("y", "x"), ("z", "x"), ("w", "z"), ("e", "elsewhere"), ("y", "a")]
    tables = make(spark, [(t,) for t in "abcdewxyz"], "table string")
    got = {r["table"]: (r.level, r.state) for r in load_order(tables, make(spark, edges, "child string, parent string")).collect()}
    assert got == {
        "a": (0, "ordered"), "b": (1, "ordered"), "c": (2, "ordered"), "d": (0, "ordered"), "e": (0, "ordered"),
        "x": (None, "cycle"), "y": (None, "cycle"), "z": (None, "behind a cycle"), "w": (None, "behind a cycle"),
    }
    assert load_order(tables.limit(0), make(spark, edges, "child string, parent string")).count() == 0
    assert {r.level for r in load_order(tables, make(spark, [], "child string, parent string")).collect()} == {0}


# -- gates, drafts, rejects -------------------------------------------------------------------------------


def test_unknown_values_close_the_gates(spark):
    samples = make(spark, [(1, 5), (1, None), (2, 5), (2, 5), (3, None), (3, None)], "s int, p int")
    assert {r.s: r.stopped for r in M.write_stop_gate(samples, "s", "p").collect()} == {1: False, 2: True, 3: False}
    polls = make(spark, [(1, i, None) for i in range(6)] + [(2, 0, True)], "s int, o int, ok boolean")
    assert [(r.s, r.failures, r.aborts) for r in M.failure_streaks(polls, "s", "o").collect()] == [(1, 6, True)]
    events = make(spark, [(1, "preflight", True), (1, "replicate", None), (1, "watch", True)], "run int, phase string, ok boolean")
    assert {r.phase for r in M.stop_at_failure(events, "run").collect()} == {"preflight", "replicate"}


def test_a_draft_covers_all_that_its_ddl_shows(spark):
    ddl = "database string, table_name string, column_name string, target_type string, review string, is_nullable string, ordinal int, key_position int"
    base = ("d", "t", "c", "int", None, "NO", 1, 1)
    drafts = set()
    for i, other in [(0, "d"), (1, "t|c"), (2, "x"), (3, "int|"), (4, ""), (4, "note"), (5, "YES"), (6, 2), (7, None)]:
        row = list(base)
        row[i] = other
        drafts.add(S.manifest(make(spark, [tuple(row)], ddl), ["database"]).first().draft)
    assert len(drafts) == 9
    moved = S.manifest(make(spark, [("d", "t|", "c", "int", None, "NO", 1, 1)], ddl), ["database"]).first().draft
    assert moved != S.manifest(make(spark, [("d", "t", "|c", "int", None, "NO", 1, 1)], ddl), ["database"]).first().draft


def test_rejects_hold_the_text_and_equal_the_report(spark):
    df = make(spark, [(1, "300", "2024-02-30", 7), (2, "abc", None, 70_000), (3, "12", "2024-02-29", None)], "id int, a string, b string, c int")
    casts = [S.Cast("a", "cast", "tinyint"), S.Cast("b", "zero_date"), S.Cast("c", "cast", "smallint")]
    out = S.conform_split(df, casts, ["id"])
    got = {tuple(r) for r in out.rejects.collect()}
    assert got == {(1, "a", "300", "out of range"), (2, "a", "abc", "not of the type"), (1, "b", "2024-02-30", "no such date"), (2, "c", "70000", "out of range")}
    assert sorted(map(tuple, out.counts.collect())) == sorted(map(tuple, S.conform_report(df, casts).collect()))
    assert sorted(map(tuple, out.rows.collect())) == sorted(map(tuple, S.conform_rows(df, casts).collect()))
    assert S.conform_split(df.limit(0), casts, ["id"]).rejects.count() == 0


def test_nothing_to_reconcile_is_an_error(spark):
    with pytest.raises(ValueError, match="nothing"):
        reconcile(spark, [])
