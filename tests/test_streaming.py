from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from twinproof.operators import changes as C
from twinproof.plans import stream_plans as P
from twinproof.session import shared_dir
from twinproof.streaming.apply import ChangeTable, latest_state, read_landed
from twinproof.streaming.watch import alerts

DDL = "k bigint, op string, pos bigint, v string"


def state(df):
    return {(r["k"], r["v"]) for r in df.collect()}


def feed(spark, folder, rows):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture
def table(spark, tmp_path):
    t = ChangeTable(str(tmp_path / "table"), ("k",))
    t.create(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k bigint, v string"), 10)
    return t


def run(spark, table, tmp_path):
    schema = spark.createDataFrame([], DDL).schema
    table.start(read_landed(spark, str(tmp_path / "in"), schema), str(tmp_path / "offsets")).awaitTermination()


def test_upsert_delete_and_snapshot_position(spark, table, tmp_path):
    feed(spark, tmp_path / "in", [(1, "u", 11, "a2"), (2, "d", 12, None), (4, "c", 13, "d"), (3, "u", 9, "stale")])
    run(spark, table, tmp_path)
    assert state(table.state(spark)) == {(1, "a2"), (3, "c"), (4, "d")}


def test_resume_applies_only_what_is_new(spark, table, tmp_path):
    feed(spark, tmp_path / "in", [(1, "u", 11, "a2")])
    run(spark, table, tmp_path)
    feed(spark, tmp_path / "in", [(1, "u", 12, "a3")])
    run(spark, table, tmp_path)
    run(spark, table, tmp_path)
    assert state(table.state(spark)) == {(1, "a3"), (2, "b"), (3, "c")}
    assert spark.read.parquet(f"{table.path}/batches").select("batch").distinct().count() == 2


def test_stale_redelivery_loses_before_and_after_compaction(spark, table, tmp_path):
    feed(spark, tmp_path / "in", [(1, "u", 20, "new"), (2, "d", 21, None)])
    run(spark, table, tmp_path)
    feed(spark, tmp_path / "in", [(1, "u", 15, "old"), (2, "u", 16, "zombie")])
    run(spark, table, tmp_path)
    want = {(1, "new"), (3, "c")}
    assert state(table.state(spark)) == want
    assert table.compact(spark) == 1
    assert state(table.state(spark)) == want
    feed(spark, tmp_path / "in", [(2, "u", 16, "zombie"), (3, "u", 22, "c2")])
    run(spark, table, tmp_path)
    assert state(table.state(spark)) == {(1, "new"), (3, "c2")}
    assert table.compact(spark) == 2 and table.compact(spark) == 2


def test_a_batch_run_twice_counts_once(spark, table):
    batch = spark.createDataFrame([(9, "c", 30, "z")], DDL)
    table.write_batch(batch, 0)
    table.write_batch(batch, 0)
    assert state(table.state(spark)) == {(1, "a"), (2, "b"), (3, "c"), (9, "z")}


def test_unfinished_generation_is_ignored(spark, table):
    half = f"{table.path}/generations/gen-00000001"
    spark.createDataFrame([('{"folders": {}, "batches": []}',)], "value string").write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).text(half)
    assert state(table.state(spark)) == {(1, "a"), (2, "b"), (3, "c")}


def test_late_change_of_another_key_survives_compaction(spark, table):
    table.write_batch(spark.createDataFrame([(1, "u", 100, "a2")], DDL), 0)
    table.compact(spark)
    table.write_batch(spark.createDataFrame([(2, "u", 50, "b2"), (1, "u", 60, "stale"), (8, "c", 10, "in snapshot")], DDL), 1)
    want = {(1, "a2"), (2, "b2"), (3, "c")}
    assert state(table.state(spark)) == want
    assert table.compact(spark) == 2 and state(table.state(spark)) == want
    removed = table.retire(spark)
    assert any(f.startswith("batches/") for f in removed) and any(f.startswith("data/gen-00000000/") for f in removed)
    assert state(table.state(spark)) == want
    # A batch that is delivered again after its folder is gone counts as applied.
    table.write_batch(spark.createDataFrame([(1, "u", 100, "a2")], DDL), 0)
    assert table.compact(spark) == 2 and state(table.state(spark)) == want


def test_two_checkpoints_keep_their_batches_apart(spark, table, tmp_path):
    schema = spark.createDataFrame([], DDL).schema
    for i in (1, 2):
        feed(spark, tmp_path / f"in{i}", [(i, "u", 20 + i, f"run{i}")])
        table.start(read_landed(spark, str(tmp_path / f"in{i}"), schema), str(tmp_path / f"offsets{i}")).awaitTermination()
    assert state(table.state(spark)) == {(1, "run1"), (2, "run2"), (3, "c")}


def test_compaction_rewrites_touched_buckets_only(spark, tmp_path):
    t = ChangeTable(str(tmp_path / "table"), ("k",), buckets=16)
    t.create(spark.range(200).selectExpr("id AS k", "'v' AS v"), 0)
    t.write_batch(spark.createDataFrame([(5, "u", 3, "new")], DDL), 0)
    t.compact(spark)
    assert len(list((tmp_path / "table/data/gen-00000001").glob("_bucket=*"))) == 1
    assert t.state(spark).count() == 200 and (5, "new") in state(t.state(spark))


def test_create_refuses_an_existing_table(spark, table):
    with pytest.raises(ValueError, match="already"):
        table.create(spark.createDataFrame([(1, "a")], "k bigint, v string"), 0)


def test_deleted_key_stays_deleted_and_may_return(spark, table):
    table.write_batch(spark.createDataFrame([(1, "d", 30, None)], DDL), 0)
    table.compact(spark)
    table.write_batch(spark.createDataFrame([(1, "u", 25, "stale")], DDL), 1)
    assert state(table.state(spark)) == {(2, "b"), (3, "c")}
    table.write_batch(spark.createDataFrame([(1, "c", 31, "back")], DDL), 2)
    assert state(table.state(spark)) == {(1, "back"), (2, "b"), (3, "c")}


def test_schema_evolution(spark, tmp_path):
    wide = spark.createDataFrame([(2, "b2", "new", "u", 11)], "k bigint, v string, extra string, op string, pos bigint")
    plain = spark.createDataFrame([(3, "c", "c", 12)], "k bigint, v string, op string, pos bigint")
    snapshot = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    strict = ChangeTable(str(tmp_path / "strict"), ("k",))
    strict.create(snapshot, 10)
    with pytest.raises(ValueError, match="extra"):
        strict.write_batch(wide, 0)
    basic = ChangeTable(str(tmp_path / "basic"), ("k",), evolution="basic")
    basic.create(snapshot, 10)
    basic.write_batch(wide, 0)
    basic.write_batch(plain, 1)
    want = {(1, "a", None), (2, "b2", "new"), (3, "c", None)}
    assert {tuple(r) for r in basic.state(spark).select("k", "v", "extra").collect()} == want
    basic.compact(spark)
    assert {tuple(r) for r in basic.state(spark).select("k", "v", "extra").collect()} == want


def test_no_generation_is_an_error(spark, tmp_path):
    t = ChangeTable(str(tmp_path), ("k",))
    (tmp_path / "generations").mkdir()
    with pytest.raises(ValueError):
        t.state(spark)


def test_four_rows_then_a_streamed_fifth(spark, tmp_path):
    t = ChangeTable(str(tmp_path / "table"), ("id",))
    ddl = "id bigint, name string"
    t.create(spark.createDataFrame([(i, f"n{i}") for i in range(1001, 1005)], ddl), 0)
    t.write_batch(spark.createDataFrame([(1005, "n5", "c", 1)], ddl + ", op string, pos bigint"), 0)
    assert t.state(spark).count() == 5


def test_streaming_aggregation_equals_batch(spark, data, tmp_path):
    changes = P.CHANGES.df(spark, data)
    landing = str(tmp_path / "in")
    for where in ("pos % 2 = 0", "pos % 2 = 1", "pos % 3 = 0"):
        changes.filter(where).coalesce(1).write.mode("append").parquet(landing)
    stream = latest_state(read_landed(spark, landing, changes.schema, files_per_batch=1), ["user_id"])
    seen = {}

    def keep(batch, batch_id):
        for r in batch.collect():
            seen[r["user_id"]] = (r["pos"], r["op"])

    q = (
        stream.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    want = {r["user_id"]: (r["pos"], r["op"]) for r in C.latest_per_key(changes, ["user_id"]).collect()}
    assert seen == want


def test_watchdog_runs_on_a_stream(spark, tmp_path):
    ddl = "slot string, wal_status string, current_lsn string, restart_lsn string, confirmed_flush_lsn string"
    rows = [("a", "reserved", "1/0", "0/0", "1/0"), ("b", "reserved", "1/0", "0/FFFFFFFF", "1/1"), ("c", "lost", "0/1", "0/1", "0/1")]
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "in"))
    stream = read_landed(spark, str(tmp_path / "in"), spark.createDataFrame([], ddl).schema)
    q = (
        alerts(stream).writeStream.format("memory").queryName("slot_alerts")
        .option("checkpointLocation", str(tmp_path / "o")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    assert {r["slot"]: r["verdict"] for r in spark.table("slot_alerts").collect()} == {"a": "abort", "c": "abort"}


# --- batch apply --------------------------------------------------------------------------------


def test_live_keys_golden(spark, data):
    live = C.latest_per_key(P.CHANGES.df(spark, data), ["user_id"]).filter("op <> 'd'")
    assert live.count() == (12 if data.endswith("sf0.001") else 120)


def test_multiset_apply(spark):
    ddl = "a int, b string"
    old = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], ddl)
    ch = spark.createDataFrame(
        [("c", None, (3, "n")), ("u", (1, "x"), (1, "y")), ("d", (2, None), None), ("d", (9, "never"), None)],
        f"op string, before struct<{ddl.replace(' int', ':int').replace(' string', ':string').replace(', ', ',')}>, "
        "after struct<a:int,b:string>",
    )
    got = {(r["a"], r["b"], r["copies"]) for r in C.apply_multiset(old, ch).collect()}
    assert got == {(1, "x", 1), (1, "y", 1), (3, "n", 1)}


def test_heaps_of_equal_rows_expand_fully(spark):
    counted = spark.createDataFrame([("hot", 250_001), ("one", 1)], "v string, copies bigint")
    got = {r["v"]: r["count"] for r in C.expand_copies(counted).groupBy("v").count().collect()}
    assert got == {"hot": 250_001, "one": 1}


def test_route_golden(spark):
    df = spark.createDataFrame([("dbz.inventory.customers",), ("dbz.inventory.a.b",), ("dbzx.inventory.c",), ("other",)], "topic string")
    got = {r["topic"]: (r["table"], r["routed"]) for r in C.route(df, "dbz").collect()}
    assert got["dbz.inventory.customers"] == ("customers", True) and got["dbz.inventory.a.b"] == ("a.b", True)
    assert got["dbzx.inventory.c"] == (None, False) and got["other"] == (None, False)
    four = spark.createDataFrame([("dbz.db.dbo.customers",), ("dbz.db.customers",)], "topic string")
    assert [r["table"] for r in C.route(four, "dbz", segments=2).orderBy(F.desc("topic")).collect()] == ["customers", None]
    odd = spark.createDataFrame([("d.z+.x.t",), ("dxz+.x.t",)], "topic string")
    assert C.route(odd, "d.z+").filter("routed").count() == 1
    assert C.route(df, "dbz", include=["orders"]).filter("routed").count() == 0


def test_tables_without_a_mark_wait(spark):
    ch = spark.createDataFrame([("a", 5), ("a", 6), ("b", 9)], "table string, pos bigint")
    assert [tuple(r) for r in C.after_high_water(ch, {"a": 5}).collect()] == [("a", 6)]


def test_orphans_ignore_null_references(spark):
    child = spark.createDataFrame([(1, 10), (2, None), (3, 99)], "id int, ref int")
    parent = spark.createDataFrame([(10,)], "pk int")
    assert [r["id"] for r in C.orphan_rows(child, parent, {"ref": "pk"}).collect()] == [3]


class FakeSession:
    """Just enough of a session to ask for the shared folder."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = master

    def getConf(self):
        return self.conf


def test_shared_dir_follows_the_cluster():
    assert shared_dir(FakeSession("hdfs://shared/ckpt/", "yarn"), "x").startswith("hdfs://shared/ckpt/twinproof/x-")
    assert shared_dir(FakeSession(None, "local[2]"), "x")
    with pytest.raises(ValueError):
        shared_dir(FakeSession(None, "spark://host:7077"), "x")
