from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.functions.canon import bucket, canonical_text, checksum, row_hash, row_text
from twinproof.operators import faults, profile
from twinproof.operators import reconcile as R
from twinproof.operators.changes import evolve
from twinproof.sources.ledger import append_ledger, parse_ledger, read_ledger
from twinproof.sources.tables import TablePair, jdbc_options, load, mark_generated

KV = "k bigint, v string"


def pair(spark, source, target, ddl=KV, keys=("k",), **kw):
    return TablePair("t", spark.createDataFrame(source, ddl), spark.createDataFrame(target, ddl), list(keys), **kw)


def kinds(df):
    return {(r["pk"], r["kind"]) for r in df.collect()}


# --- row hash ---------------------------------------------------------------------------------


@pytest.mark.parametrize("portable", [False, True])
def test_nulls_keep_their_place(spark, portable):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("", "a"), ("a", "")], "x string, y string")
    hashes = [r[0] for r in df.select(row_hash(df.schema, ["x", "y"], portable=portable)).collect()]
    assert len(set(hashes)) == 4


@pytest.mark.parametrize("portable", [False, True])
def test_separators_in_values_do_not_collide(spark, portable):
    df = spark.createDataFrame([("a,b", "c"), ("a", "b,c"), ('a","b', "c"), ("a", 'b","c')], "x string, y string")
    assert df.select(row_hash(df.schema, ["x", "y"], portable=portable).alias("h")).distinct().count() == 4


def test_negative_zero_differs_as_its_text_does(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    assert df.select(row_hash(df.schema, ["x"]).alias("h")).distinct().count() == 2


def test_more_columns_than_one_flag_word(spark):
    names = [f"c{i}" for i in range(70)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    base = ["x"] * 70
    rows = [tuple(base)] + [tuple(None if j == i else "x" for j in range(70)) for i in (0, 30, 31, 62, 69)]
    df = spark.createDataFrame(rows, schema)
    assert df.select(row_hash(df.schema, names).alias("h")).distinct().count() == len(rows)


def test_types_that_differ_only_in_width_agree(spark):
    p = TablePair(
        "t",
        spark.createDataFrame([(1, "a", 5)], "k int, v string, n smallint"),
        spark.createDataFrame([(1, "a", 5)], "k bigint, v string, n int"),
        ["k"],
    )
    assert R.full_report(p).first()["match"]


def test_mixed_types_fall_back_to_text(spark):
    p = TablePair(
        "t",
        spark.createDataFrame([(1, "5")], "k int, v string"),
        spark.createDataFrame([(1, 5)], "k int, v int"),
        ["k"],
    )
    assert R.full_report(p).first()["match"]


def test_canonical_text_per_type(spark):
    df = spark.sql(
        """SELECT true b, 7Y t, 12.50BD d, date'2024-01-02' day, timestamp'2024-01-02 03:04:05.1' ts,
        timestamp_ntz'2024-01-02 03:04:05' tn, x'0AFF' bin, array('a', null) arr, map('b', 1, 'a', 2) m,
        named_struct('x', cast(null as int), 'y', 1) s, 1.5D f, interval '2' hour i, parse_json('{"b":1,"a":2}') v"""
    )
    got = df.select(*[canonical_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first().asDict()
    assert got["b"] == "true" and got["t"] == "7" and got["d"] == "12.50" and got["day"] == "2024-01-02"
    assert got["ts"] == "2024-01-02 03:04:05.100000" and got["tn"] == "2024-01-02 03:04:05.000000"
    assert got["bin"] == "0aff" and got["arr"] == '["a",null]' and got["s"] == '{"x":null,"y":1}'
    assert got["m"] == '[{"key":"a","value":2},{"key":"b","value":1}]' and got["v"] == '{"a":2,"b":1}'
    assert got["f"] == "1.5" and got["i"]


def test_row_text_is_json(spark):
    df = spark.createDataFrame([(1, None, 'q"')], "a int, b string, c string")
    assert df.select(row_text(df.schema, df.columns)).first()[0] == '["1",null,"q\\""]'


def test_bucket_of_smallest_long(spark):
    df = spark.range(1).select(bucket(F.lit(-(2**63)).cast("bigint"), 256).alias("b"))
    assert df.first()["b"] == 0


def test_checksum_counts_duplicates_and_does_not_overflow(spark):
    df = spark.range(4).select(F.lit(2**63 - 1).alias("h"))
    assert int(df.agg(checksum(F.col("h"))).first()[0]) == 4 * (2**63 - 1)
    assert int(df.filter("false").agg(checksum(F.col("h"))).first()[0]) == 0


# --- bucket compare and drill -------------------------------------------------------------------


@pytest.mark.parametrize(
    "target, bad",
    [
        ([(1, "a"), (2, "b")], 0),
        ([(1, "a"), (2, "x")], 1),
        ([(1, "a")], 1),
        ([(1, "a"), (2, "b"), (2, "b")], 1),
    ],
)
def test_bucket_report(spark, target, bad):
    report = R.bucket_report(pair(spark, [(1, "a"), (2, "b")], target), buckets=1_000_003)
    assert report.filter("NOT match").count() == bad


def test_absent_bucket_counts_as_zero(spark):
    row = R.bucket_report(pair(spark, [(1, "a")], [])).first()
    assert (row["source_rows"], row["target_rows"], int(row["target_sum"]), row["match"]) == (1, 0, 0, False)


def test_full_report_sees_counts(spark):
    row = R.full_report(pair(spark, [(1, "a")] * 10, [(1, "a")] * 11)).first()
    assert (row["source_rows"], row["target_rows"], row["match"]) == (10, 11, False)


def test_classify_golden(spark):
    p = pair(spark, [(1, "a"), (2, "b"), (3, "c")], [(1, "a"), (2, "CHANGED"), (4, "z")])
    assert kinds(R.drill(p)) == {("2", "hash_diff"), ("3", "missing_on_target"), ("4", "extra_on_target")}
    assert R.examples(R.drill(p), 2).count() == 2


def test_examples_put_source_rows_before_extras(spark):
    p = pair(spark, [(3, "c")], [(4, "z")])
    got = R.examples(R.drill(p, buckets=1)).orderBy("rank").collect()
    assert [r["kind"] for r in got] == ["missing_on_target", "extra_on_target"]


def test_repeated_keys_are_compared_as_multisets(spark):
    same = pair(spark, [(1, "a"), (1, "b")], [(1, "b"), (1, "a")])
    assert R.drill(same).count() == 0
    other = pair(spark, [(1, "a"), (1, "a")], [(1, "a"), (1, "b")])
    assert kinds(R.drill(other)) == {("1", "hash_diff")}


def test_no_key_uses_whole_rows(spark):
    p = pair(spark, [(1, "a"), (1, "a"), (2, None)], [(1, "a"), (2, None), (2, None)], keys=())
    got = {(r["k"], r["kind"], r["copies"]) for r in R.multiset_diff(p).collect()}
    assert got == {(1, "missing_on_target", 1), (2, "extra_on_target", 1)}
    assert R.bucket_report(p).filter("NOT match").count() > 0


def test_generated_columns_are_left_out(spark):
    df = spark.createDataFrame([(1, "a", "x")], "k bigint, v string, g string")
    source = mark_generated(df, ["g"])
    target = source.withColumn("g", F.lit("other"))
    assert TablePair("t", source, target, ["k"]).hash_columns == ["k", "v"]
    assert R.full_report(TablePair("t", source, target, ["k"])).first()["match"]
    assert not R.full_report(TablePair("t", source, target, ["k"], ["k", "v", "g"])).first()["match"]


def test_missing_column_is_an_error(spark):
    p = TablePair("t", spark.createDataFrame([(1, "a")], KV), spark.createDataFrame([(1,)], "k bigint"), ["k"])
    with pytest.raises(ValueError, match="missing on one side"):
        R.bucket_report(p)


def test_refine_gives_the_same_rows(spark):
    source = spark.range(20_000).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("v"))
    target = source.filter("k <> 77").withColumn("v", F.when(F.col("k") == 4242, "x").otherwise(F.col("v")))
    prints = R.fingerprints(TablePair("t", source, target, ["k"]), 16)
    sums = R.bucket_sums(prints)
    refined = R.refine(prints, sums, 256, 16)
    assert R.suspect_keys(refined).count() == 2
    assert refined.count() < R.drill_prints(prints, sums).count() / 20
    assert kinds(R.classify(refined)) == {("77", "missing_on_target"), ("4242", "hash_diff")}
    assert R.suspect_keys(R.refine(prints, sums, 1 << 20, 16)).count() == 2


def test_reconcile_job(spark, data):
    orders = load(spark, data, "orders")
    target = faults.lose_rows(orders, F.col("o_orderkey") == 5)
    pairs = [TablePair("orders", orders, target, ["o_orderkey"]), TablePair("same", orders, orders, ["o_orderkey"])]
    report, found, shown, ok = R.reconcile(spark, pairs)
    assert kinds(shown) == kinds(found)
    got = {r["table"]: r for r in report.collect()}
    assert not ok and got["same"]["match"] and len(got["orders"]["mismatched_buckets"]) == 1
    assert kinds(found) == {("5", "missing_on_target")}
    assert R.reconcile(spark, pairs[1:]).ok
    lines = load(spark, data, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    more = lines.unionByName(spark.createDataFrame([("A", "F", 1), ("A", "F", 1), ("Z", None, 0)], lines.schema))
    _, rows, _, ok = R.reconcile(spark, [TablePair("heap", lines, more)])
    assert not ok and kinds(rows) == {("A,F,1", "extra_on_target"), ("Z,,0", "extra_on_target")}
    none = spark.createDataFrame([], "id string")
    assert R.reconcile(spark, pairs[1:], ledger=none).ok
    assert not R.reconcile(spark, pairs[1:], ledger=spark.createDataFrame([("x",)], "id string")).ok
    many = R.reconcile(spark, [TablePair("all", orders, orders.filter("o_orderkey % 5 > 0"), ["o_orderkey"])])
    assert many.examples.count() == 20 and many.rows.count() == orders.filter("o_orderkey % 5 = 0").count()


def test_orders_golden(spark):
    """Fixed counts of the derived orders pair at the smallest scale."""
    from twinproof.plans.parity import orders_pair

    p = orders_pair(spark, "/root/testdata/sf0.001")
    totals = R.full_report(p).first()
    assert (totals["source_rows"], totals["target_rows"], totals["mismatched_buckets"]) == (1500, 1492, [0])
    found = {r["kind"]: r["count"] for r in R.drill(p).groupBy("kind").count().collect()}
    assert found == {R.MISSING: 16, R.DIFFERENT: 14, R.EXTRA: 8}
    # Both hash modes agree on everything but the bucket numbers.
    portable = R.drill(p, portable=True).select("pk", "kind")
    assert portable.exceptAll(R.drill(p).select("pk", "kind")).count() == 0 and portable.count() == 38


def test_multiset_diff_agrees_with_except_all(spark):
    from twinproof.plans.parity import lineitem_pair

    p = lineitem_pair(spark, "/root/testdata/sf0.001")
    diff = {r["kind"]: r["n"] for r in R.multiset_diff(p).groupBy("kind").agg(F.sum("copies").alias("n")).collect()}
    source, target = p.sides()
    assert diff == {R.MISSING: source.exceptAll(target).count(), R.EXTRA: target.exceptAll(source).count()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.dictionaries(st.integers(-50, 50), st.one_of(st.none(), st.text(max_size=4)), max_size=25),
    drop=st.sets(st.integers(-50, 50), max_size=5),
    edit=st.sets(st.integers(-50, 50), max_size=5),
    add=st.sets(st.integers(100, 120), max_size=4),
)
def test_exactly_the_perturbed_keys(spark, rows, drop, edit, add):
    source = list(rows.items())
    target = [(k, (v or "") + "!" if k in edit else v) for k, v in source if k not in drop] + [(k, "n") for k in add]
    want = {(str(k), "missing_on_target") for k in rows if k in drop}
    want |= {(str(k), "hash_diff") for k in rows if k in edit and k not in drop}
    want |= {(str(k), "extra_on_target") for k in add}
    assert kinds(R.drill(pair(spark, source, target))) == want
    p = pair(spark, source, list(reversed(source)))
    shuffled = TablePair("t", p.source, p.target.repartition(5, "v").select("v", "k"), ["k"])
    assert R.drill(shuffled).count() == 0 and R.full_report(shuffled).first()["match"]


def test_persisted_prints_are_narrow(spark):
    p = pair(spark, [(1, "a" * 1000)], [(1, "b")], keys=())
    assert R.persist_fingerprints(spark, p).columns == ["on_source", "b", "kh", "h"]


# --- ledger and counts --------------------------------------------------------------------------


def test_ledger(spark, tmp_path):
    ids = spark.range(25_000).select(F.col("id").cast("string").alias("id"))
    path = str(tmp_path / "ledger")
    append_ledger(ids.filter("id < 10"), "id", path)
    append_ledger(ids.filter("id >= 10"), "id", path)
    ledger = read_ledger(spark, path)
    assert ledger.count() == 25_000
    assert R.ledger_missing(ledger, ids, "id").count() == 0
    assert R.ledger_missing(ledger, ids.filter("id NOT IN ('3', '24999')"), "id").count() == 2
    blank = parse_ledger(spark.createDataFrame([(" ",), ("",), (" 7 ",)], "value string"))
    assert [r[0] for r in blank.collect()] == ["7"]


def test_jdbc_options():
    plain = jdbc_options("jdbc:x", "t")
    assert plain["dbtable"] == "t" and "partitionColumn" not in plain
    split = jdbc_options("jdbc:x", "t", key="id", bounds=(0, 100), partitions=4)
    assert (split["partitionColumn"], split["numPartitions"]) == ("id", "4")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", key="id")


# --- profile ------------------------------------------------------------------------------------


def test_metrics_per_class():
    assert profile.METRICS[profile.category(T.IntegerType())] == ("non_null", "sum", "min", "max")
    assert profile.METRICS[profile.category(T.StringType())] == ("non_null", "char_len_sum")
    for t in (T.DateType(), T.TimestampType(), T.DayTimeIntervalType(), T.BooleanType(), T.BinaryType(), T.ArrayType(T.StringType())):
        assert profile.METRICS[profile.category(t)] == ("non_null",)


def cells(df):
    return {(r["column"], r["metric"]): r["value"] for r in df.collect()}


def test_profile_values(spark):
    df = spark.createDataFrame(
        [(1, 0.1, "ab ", None), (2, 0.2, None, None), (None, 2.5e13, "日本", None)], "i int, f double, s string, n int"
    )
    got = cells(profile.table_profile(df))
    assert got[(None, "row_count")] == "3" and got[("i", "sum")] == "3" and got[("i", "min")] == "1"
    assert got[("f", "sum")] == "25000000000000.300000" and got[("s", "char_len_sum")] == "5"
    assert got[("n", "non_null")] == "0" and got[("n", "sum")] is None and got[("n", "max")] is None
    assert cells(profile.table_profile(df, trim_blanks=True))[("s", "char_len_sum")] == "4"


def test_profile_sum_beyond_long_and_negative(spark):
    big = 2**62
    df = spark.createDataFrame([(big,), (big,), (big,), (-1,)], "i bigint")
    assert cells(profile.table_profile(df))[("i", "sum")] == str(3 * big - 1)
    neg = spark.createDataFrame([(-1.25,), (-3.5,)], "f double")
    assert cells(profile.table_profile(neg))[("f", "sum")] == "-4.750000"


def test_profile_of_nothing(spark):
    got = cells(profile.table_profile(spark.createDataFrame([], "i int, f double")))
    assert got[(None, "row_count")] == "0" and got[("f", "sum")] is None


def test_profile_diff_golden(spark):
    s = spark.createDataFrame([(None, "row_count", "4"), ("a", "non_null", "4"), ("a", "sum", "100"), ("b", "non_null", "1"), ("n", "sum", None)], "column string, metric string, value string")
    t = spark.createDataFrame([(None, "row_count", "5"), ("a", "non_null", "4"), ("a", "sum", "101"), ("c", "non_null", "1"), ("n", "sum", "3")], "column string, metric string, value string")
    got = {tuple(r) for r in profile.diff_profiles(s, t).collect()}
    assert got == {
        ("row_count", None, "row_count", "4", "5", None),
        ("column_metric", "a", "sum", "100", "101", None),
        ("column_metric", "n", "sum", None, "3", None),
        ("column_missing", "b", None, None, None, "target"),
        ("column_missing", "c", None, None, None, "source"),
    }
    assert profile.diff_profiles(s, s).count() == 0


def test_profile_misses_edits_of_equal_length(spark):
    p = pair(spark, [(1, "ab")], [(1, "xy")])
    row = profile.profile_report("t", p.source, p.target).first()
    assert row["match"] and "not detected" in row["caveat"]


# --- evolution ----------------------------------------------------------------------------------


def test_evolve_adds_but_never_retypes(spark):
    t = spark.createDataFrame([(1,)], "a int")
    out = evolve(t, spark.createDataFrame([(2, "x")], "a int, b string"))
    assert {tuple(r) for r in out.collect()} == {(1, None), (2, "x")}
    with pytest.raises(ValueError):
        evolve(t, spark.createDataFrame([("2",)], "a string"))
