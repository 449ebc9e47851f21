"""Keyed watches against plain loops under any cut into batches; kept fingerprints; images as VARIANT."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.operators import reconcile as R
from twinproof.operators import variants as V
from twinproof.operators.changes import apply_changes
from twinproof.session import shared_dir
from twinproof.sources.tables import TablePair
from twinproof.streaming.prints import PrintStore, compare_sums, drill_stores
from twinproof.streaming.watch import Deadlines, Streaks


class Handle:
    """State of one series and its timers, in memory."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema, ttl=None):
        return SimpleNamespace(get=lambda: self.value, update=lambda v: setattr(self, "value", v))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def cut(rows, rnd):
    """Into batches in order; inside a batch shuffled, in one or two pieces, and sometimes with rows delivered before."""
    out, i = [], 0
    while i < len(rows):
        j = i + rnd.randint(1, 7)
        batch = rows[i:j] + (rows[max(0, i - 3) : i] if rnd.random() < 0.3 else [])
        rnd.shuffle(batch)
        out.append(batch)
        i = j
    return out


def frames(batch, columns):
    half = max(1, len(batch) // 2)
    return iter([pd.DataFrame(part, columns=columns) for part in (batch[:half], batch[half:]) if part])


def plain_streaks(rows, limit):
    out, run = [], []
    for at, good in rows:
        if good:
            if run:
                out.append(("ended", len(run), run[0], run[-1]))
            run = []
        else:
            run.append(at)
            if len(run) == limit:
                out.append(("abort", limit, run[0], at))
    return sorted(out)


@pytest.mark.parametrize("seed", range(40))
def test_streaks_equal_a_plain_loop(seed):
    rnd = random.Random(seed)
    rows = [(i * 3, rnd.random() < rnd.choice((0.1, 0.5, 0.9))) for i in range(rnd.randint(1, 60))]
    handle, found = Handle(), []
    for batch in cut(rows, rnd):
        processor = Streaks("s", 3)
        processor.init(handle)
        for out in processor.handleInputRows((7,), frames(batch, ["nth", "good"]), None):
            assert set(out["s"]) == {7}
            found += list(out.drop(columns="s").itertuples(index=False, name=None))
    assert sorted(found) == plain_streaks(rows, 3)


def plain_deadlines(rows, mark, allowed, quiet):
    at = sorted({a for a, _ in rows})
    ready = sorted(a for a, r in rows if r)
    deadline, out = at[0] + allowed, []
    if ready and ready[0] <= deadline:
        out.append(("done", ready[0]))
    elif at[-1] > deadline or mark > deadline:
        out.append(("timeout", deadline))
    for a, b in zip(at, [*at[1:], mark]):
        if b > a + quiet:
            out.append(("silent", a + quiet))
    return sorted(out)


@pytest.mark.parametrize("seed", range(60))
def test_deadlines_equal_a_plain_loop(seed):
    """Timers fire after each batch for whatever the watermark has passed, as other series move it."""
    rnd = random.Random(seed)
    at, rows = 1000, []
    for _ in range(rnd.randint(1, 30)):
        at += rnd.choice((1, 2, 5, 40))
        rows.append((at, rnd.random() < 0.1))
    allowed, quiet = rnd.choice(((30, 10), (10, 10), (100, 20))), None
    allowed, quiet = allowed
    handle, found = Handle(), []
    mark = 0

    def fire(mark):
        while due := sorted(t for t in handle.timers if t < mark):
            handle.timers.discard(due[0])
            processor = Deadlines("s", allowed, quiet)
            processor.init(handle)
            for out in processor.handleExpiredTimer((7,), None, SimpleNamespace(getExpiryTimeInMs=lambda: due[0])):
                found.extend(out.drop(columns="s").itertuples(index=False, name=None))

    batches = cut(rows, rnd)
    for i, batch in enumerate(batches):
        processor = Deadlines("s", allowed, quiet)
        processor.init(handle)
        for out in processor.handleInputRows((7,), frames(batch, ["ms", "good"]), None):
            found.extend(out.drop(columns="s").itertuples(index=False, name=None))
        upto = max(a for a, _ in batch)
        later = min((a for b in batches[i + 1 :] for a, _ in b if a > upto), default=upto + 200)
        mark = max(mark, rnd.randint(upto, later))
        fire(mark)
    assert sorted(found) == plain_deadlines(rows, mark, allowed, quiet)


# -- kept fingerprints --------------------------------------------------------------------------------

ROWS = "k bigint, part string, v string"
CHANGES = "pos bigint, op string, k bigint, part string, v string"


def store(spark, name, **kwargs):
    return PrintStore(shared_dir(spark, name), ["k", "part"], ["k", "part", "v"], buckets=8, **kwargs)


def sums(df):
    return {(r["b"], r["source_rows"], r["target_rows"], r["source_sum"], r["target_sum"], r["match"]) for r in df.collect()}


def test_kept_sums_equal_those_of_the_tables(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else "p", f"v{i}") for i in range(60)], ROWS)
    first = spark.createDataFrame([(1, "d", 3, "p", None), (2, "u", 4, None, "new"), (3, "c", 100, None, "x"), (4, "d", 999, "p", None), (5, "u", 5, "p", "v5")], CHANGES)
    second = spark.createDataFrame([(6, "c", 3, "p", "again"), (7, "d", 100, None, None), (8, "u", 4, None, "newer"), (9, "u", 4, None, "newest")], CHANGES)
    one, two = store(spark, "one"), store(spark, "two")
    for s in (one, two):
        s.create(spark, rows)
        s.advance(spark, first, 1)
    one.advance(spark, second, 2)
    one.advance(spark, second, 2)  # repeated after a failure
    then = apply_changes(rows, first, ["k", "part"])
    now = apply_changes(then, second, ["k", "part"])
    columns = ["k", "part", "v"]
    pair = TablePair("t", now.select(*columns), then.select(*columns), ["k", "part"])
    assert sums(compare_sums(spark, one, two)) == sums(R.bucket_report(pair, 8))
    want = {(r["bucket"], r["pk"], r["kind"]) for r in R.drill(pair, 8).collect()}
    assert want and {tuple(r) for r in drill_stores(spark, one, two).collect()} == want


def test_drill_skips_equal_buckets(spark):
    rows = spark.createDataFrame([(i, "p", f"v{i}") for i in range(60)], ROWS)
    one, two = store(spark, "one"), store(spark, "two")
    for s in (one, two):
        s.create(spark, rows)
    two.advance(spark, spark.createDataFrame([(1, "u", 3, "p", "other")], CHANGES), 1)
    found = drill_stores(spark, one, two)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["pk"], r["kind"]) for r in found.collect()] == [("3,p", R.DIFFERENT)]


def test_stores_without_rows_and_with_repeated_ones(spark):
    none, some = store(spark, "none"), store(spark, "some")
    none.create(spark, spark.createDataFrame([], ROWS))
    some.create(spark, spark.createDataFrame([(1, "p", "a"), (1, "p", "a")], ROWS))
    assert compare_sums(spark, none, none).count() == 0
    assert [(r["source_rows"], r["target_rows"], r["match"]) for r in compare_sums(spark, none, some).collect()] == [(0, 2, False)]
    some.advance(spark, spark.createDataFrame([(1, "d", 1, "p", None)], CHANGES), 1)  # a delete takes all copies
    assert compare_sums(spark, none, some).count() == 0
    with pytest.raises(ValueError):
        some.advance(spark, spark.createDataFrame([], CHANGES), 0)
    with pytest.raises(ValueError):
        compare_sums(spark, some, store(spark, "other", portable=True))


# -- images as VARIANT ----------------------------------------------------------------------------------


def images(spark, *texts):
    return V.as_variant(spark.createDataFrame(list(enumerate(texts)), "pos bigint, text string"), "text")


def test_only_objects_are_images(spark):
    out = images(spark, '{"a":1}', "{", "[1]", "3", "null", "", None, "{}").orderBy("pos").collect()
    assert [r["reason"] for r in out] == [None, *[V.BROKEN] * 5, None, None]
    assert [r["image"] is None for r in out] == [False, *[True] * 6, False]


def test_unknown_fields_at_any_depth(spark):
    declared = T.StructType.fromDDL("a bigint, b struct<c: string>")
    df = images(spark, '{"a":1,"b":{"c":"x","d, e":[1,2]}}', '{"q\'s":{"z":1,"y":{"w":true}},"b":{"c":"y"}}', '{"b":{"d, e":[]},"a":null}', None)
    found = {(r["path"], r["images"], r["first_pos"]) for r in V.unknown_fields(df, declared).collect()}
    assert found == {("b.d, e", 2, 0), ("q's", 1, 1)}
    assert V.unknown_fields(images(spark, None), declared).count() == 0
    assert V.unknown_fields(images(spark), declared).count() == 0
    with pytest.raises(ValueError):
        V.json_path(("a'\"b",))


def test_values_of_another_type_are_named(spark):
    declared = T.StructType.fromDDL("a bigint, b string")
    out = V.open_variant(images(spark, '{"a":5,"b":"x"}', '{"a":"no","b":null}', '{"b":{"k":1}}', None), declared).orderBy("pos").collect()
    assert [(r["a"], r["misfit"]) for r in out] == [(5, []), (None, ["a"]), (None, []), (None, [])]
    assert out[0]["b"] == "x" and out[2]["b"] == '{"k":1}'
    assert all(r["image"] is not None for r in out[:3])
