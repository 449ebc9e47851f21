"""Hot keys: the work is merged before the shuffle, and the results stay whole."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from twinproof.functions.ordered import _pieces, with_previous, with_running_count
from twinproof.operators import changes as C
from twinproof.operators import monitor as M
from twinproof.operators import reconcile as R
from twinproof.operators import rules as Q
from twinproof.sources.tables import TablePair
from twinproof.streaming.apply import read_kafka

N = 300_000


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """A third of the rows belongs to one user."""
    path = str(tmp_path_factory.mktemp("hot") / "t")
    user = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000)
    spark.range(N).select(
        user.alias("user"), F.col("id").alias("pos"), F.when(F.col("id") % 10 < 7, "u").otherwise("d").alias("op"), (F.col("id") % 13).alias("v")
    ).write.parquet(path)
    return spark.read.parquet(path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def below_exchange(df, text: str) -> bool:
    """Does the operator appear under a shuffle, on the map side?"""
    p = plan(df)
    return text in p[p.index("Exchange hashpartitioning") :]


def test_latest_merges_before_the_shuffle(hot):
    latest = C.latest_per_key(hot, ["user"])
    assert below_exchange(latest, "partial_max_by")
    assert latest.filter("user = 7").first()["pos"] == N - 3
    assert latest.count() == 1000


def test_parity_merges_before_the_shuffle(hot):
    p = TablePair("t", hot, hot.filter("pos <> 3000"), ["user"], ["user", "op", "v"])
    assert below_exchange(R.classify(R.fingerprints(p)), "partial_sum") and below_exchange(R.bucket_report(p), "partial_sum")
    assert [(r["pk"], r["kind"]) for r in R.drill(p).collect()] == [("7", "hash_diff")]
    keyless = TablePair("t", hot.select("user"), hot.filter("pos <> 3000").select("user"))
    assert below_exchange(R.multiset_diff(keyless), "partial_sum")
    assert [(r["user"], r["copies"]) for r in R.multiset_diff(keyless).collect()] == [(7, 1)]


def test_findings_merge_before_the_shuffle(hot):
    lints = hot.select(
        F.lit("n").alias("name"), F.lit("s").alias("schema"), F.lit("e").alias("entity"), F.lit("WARN").alias("level"), F.col("pos").alias("ordinal")
    )
    out = Q.dedupe_lints(lints)
    assert below_exchange(out, "partial_min_by") and out.first()["ordinal"] == 0


def test_examples_prune_before_the_shuffle(spark, hot):
    found = [
        hot.select(F.lit(t).alias("table"), (F.col("pos") % 256).alias("bucket"), F.col("pos").cast("string").alias("pk"), F.lit(R.MISSING).alias("kind"))
        for t in ("a", "b")
    ]
    out = R.examples(found[0].unionByName(found[1]))
    assert "WindowGroupLimit" in plan(out) and out.count() == 40


def test_long_series_span_many_pieces(hot):
    ordered = hot.withColumn("ok", F.col("v") > 0)
    pieces = _pieces(ordered, ["user"], "pos", 64).groupBy("user", "_piece").count().collect()
    # The hot user is cut into even pieces, the others stay whole.
    assert {r["user"] for r in pieces if r["_piece"] is not None} == {7}
    assert max(r["count"] for r in pieces if r["user"] == 7) < 4 * (N // 3) / 64
    streaks = M.failure_streaks(ordered, "user", "pos", limit=2)
    assert streaks.agg(F.sum("failures")).first()[0] == hot.filter("v = 0").count()
    rising = M.rising(ordered, ["v"], "user", "pos")
    assert rising.count() == N and rising.filter("NOT has_prev").count() == 1000
    # User 7 sees every third position, so v moves by 3 modulo 13 and falls 3 times in 13.
    assert abs(rising.filter("user = 7 AND rising").count() / rising.filter("user = 7").count() - 10 / 13) < 0.01


def test_many_series_below_the_share_are_cut_by_size(spark):
    """A hundred equal series, none of which holds one row in 64, and short ones that stay whole."""
    i = F.col("id")
    rows = spark.range(N).select(F.when(i % 10 > 0, i % 100).otherwise(i + 1000).alias("s"), (i * 7919 % 1_000_003).alias("pos"), (i % 13).alias("v"))
    pieces = _pieces(rows, ["s"], "pos", 64, rows=500).groupBy("s", "_piece").count().collect()
    cut = [r for r in pieces if r["_piece"] is not None]
    assert {r["s"] for r in cut} == {x for x in range(100) if x % 10} and sum(r["count"] for r in cut) == N * 9 // 10
    assert max(r["count"] for r in cut) < 4 * 500 and len(cut) == 90 * 6
    w = Window.partitionBy("s").orderBy("pos")
    want = rows.select("s", "pos", F.lag("v").over(w).alias("prev_v"), F.sum((F.col("v") == 0).cast("long")).over(w).alias("c"))
    got = with_running_count(with_previous(rows, ["s"], "pos", ["v"], rows=500), ["s"], "pos", F.col("v") == 0, "c", rows=500)
    assert got.select("s", "pos", "prev_v", "c").exceptAll(want).count() == 0 and got.count() == N


def test_pieces_have_a_bound_of_their_own(spark, monkeypatch):
    """Beyond rows * PIECES rows the pieces grow; boundaries stay few enough to broadcast."""
    monkeypatch.setattr("twinproof.functions.ordered.PIECES", 16)
    rows = spark.range(40_000).select((F.col("id") % 4).alias("s"), F.col("id").alias("pos"), F.col("id").alias("v"))
    pieces = _pieces(rows, ["s"], "pos", 2, rows=10)
    assert pieces.select("s", "_piece").distinct().count() == 16
    out = with_previous(rows, ["s"], "pos", ["v"], 2, rows=10)
    assert out.filter("has_prev AND prev_v = pos - 4").count() == 40_000 - 4 and out.filter("NOT has_prev").count() == 4


def test_a_piece_is_found_by_binary_search_in_two_levels(spark, monkeypatch):
    """More boundaries than one look-up searches; every position lies in the piece that counting the boundaries gives."""
    monkeypatch.setattr("twinproof.functions.ordered._GROUP", 16)
    rows = spark.range(5_000).select((F.col("id") % 2).alias("s"), (F.col("id") * 3).alias("pos"), F.col("id").alias("v"))
    got = _pieces(rows, ["s"], "pos", 64, rows=25).groupBy("s", "_piece").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n")).orderBy("s", "_piece").collect()
    assert len(got) > 2 * 64 and sum(r["n"] for r in got) == 5_000 and max(r["n"] for r in got) < 4 * 25
    assert all(a["hi"] < b["lo"] for a, b in zip(got, got[1:]) if a["s"] == b["s"])
    out = with_previous(rows, ["s"], "pos", ["v"], rows=25)
    assert out.filter("has_prev AND prev_v = v - 2").count() == 4_998


def test_one_hot_and_many_sparse_series_with_times(spark):
    """Positions are timestamps; a third of the rows is one series, the rest 10^5 series of two rows."""
    i = F.col("id")
    rows = spark.range(300_000).select(
        F.when(i % 3 == 0, F.lit(-1)).otherwise(i % 100_000).alias("s"), F.timestamp_seconds(i * i % 1_000_000_007).alias("at"), (i % 7).alias("v")
    )
    out = with_previous(rows, ["s"], "at", ["v"])
    w = Window.partitionBy("s").orderBy("at")
    want = rows.select("s", "at", "v", F.lag("v").over(w).alias("prev_v"))
    assert out.select("s", "at", "v", "prev_v").exceptAll(want).count() == 0 and out.count() == 300_000
    # The samples meet one shuffle; everything else that is exchanged is small.
    assert "SortMergeJoin" not in plan(out)


def test_kafka_needs_its_package(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        read_kafka(spark, "host:9092", ["a", "b"])
