"""Watchdogs over a stream of metric samples: verdicts per sample, failure streaks, deadlines and silence.

Streaks and deadlines are keyed state, a few numbers a series, in the RocksDB store of the query's checkpoint. Deadlines fire by
event time: a series that stops reporting still times out once other series have moved the watermark past its deadline. The
outcome does not depend on how samples are cut into micro-batches, as long as no sample comes later than the watermark allows.

A micro-batch's samples of one series are ordered in the task that holds its state: a few narrow numbers a sample, and no more of them than the trigger
admits (``maxFilesPerTrigger`` or ``maxOffsetsPerTrigger``), however long the stream has run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from twinproof.functions.canon import quoted
from twinproof.operators.monitor import MAX_FAILURES, retained_watchdog, slot_lag
from twinproof.streaming.keyed import ROCKSDB


def watch_slots(samples: DataFrame, max_mb: float = 2048) -> DataFrame:
    """Verdict per slot sample; a projection, so it runs on batches and streams alike."""
    return retained_watchdog(slot_lag(samples), max_mb)


def alerts(samples: DataFrame, max_mb: float = 2048) -> DataFrame:
    return watch_slots(samples, max_mb).filter(F.col("verdict") != "ok")


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def _in_order(batches: Iterator[pd.DataFrame], order: str, flag: str, after: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Orders and flags of one series' new samples, ascending; samples at or before ``after`` were seen already."""
    at, good = [], []
    for batch in batches:
        at.append(batch[order].to_numpy(np.int64))
        good.append(batch[flag].to_numpy(bool))
    at, good = np.concatenate(at), np.concatenate(good)
    new = np.ones(len(at), bool) if after is None else at > after
    at, good = at[new], good[new]
    by = np.argsort(at, kind="stable")
    return at[by], good[by]


class Streaks(StatefulProcessor):
    """Events of failed polls: ``abort`` at the poll that reaches the limit, ``ended`` at the clean poll behind a streak."""

    def __init__(self, series: str, limit: int):
        self.series, self.limit = series, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", _longs("last", "failures", "first", "latest"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, n, first, latest = self.open.get() or (None, 0, 0, 0)
        at, ok = _in_order(rows, "nth", "good", last)
        if not len(at):
            return
        events = []
        # Clean polls cut the batch; only the first piece goes on from the state.
        cuts = np.flatnonzero(ok)
        begins, ends = np.r_[0, cuts + 1], np.r_[cuts, len(at)]
        for i in np.flatnonzero((ends > begins) | ((np.arange(len(ends)) == 0) & (n > 0))):
            b, e = int(begins[i]), int(ends[i])
            carried = n if i == 0 else 0
            start = first if carried else int(at[b])
            total, end = carried + e - b, int(at[e - 1]) if e > b else latest
            if carried < self.limit <= total:
                events.append(("abort", self.limit, start, int(at[b + self.limit - carried - 1])))
            if e < len(at):
                events.append(("ended", total, start, end))
            else:
                n, first, latest = total, start, end
        if ok[-1]:
            n, first, latest = 0, 0, 0
        self.open.update((int(at[-1]), int(n), int(first), int(latest)))
        if events:
            out = pd.DataFrame(events, columns=["event", "failures", "first", "last"])
            out.insert(0, self.series, key[0])
            yield out

    def close(self) -> None:
        pass


def streak_events(polls: DataFrame, series: str, order: str, ok: str = "ok", limit: int = MAX_FAILURES) -> DataFrame:
    """(series, event, failures, first, last) on a stream of polls; the counterpart of ``monitor.failure_streaks``.

    A poll whose result is unknown has failed; one without a series or an order is left out. ``order`` rises within a series from batch to batch, and a poll
    delivered again is ignored. ``last`` of an abort is the poll that reached the limit. A streak that is still open has no ``ended``.
    """
    polls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    clean = F.coalesce(quoted(ok), F.lit(False))
    narrow = polls.select(quoted(series).alias("series"), quoted(order).cast("bigint").alias("nth"), clean.alias("good"))
    narrow = narrow.filter(F.col("series").isNotNull() & F.col("nth").isNotNull())
    out = [T.StructField(series, polls.schema[series].dataType), T.StructField("event", T.StringType()), *_longs("failures", "first", "last").fields]
    return narrow.groupBy("series").transformWithStateInPandas(
        statefulProcessor=Streaks(series, limit), outputStructType=T.StructType(out), outputMode="append", timeMode="none"
    )


class Deadlines(StatefulProcessor):
    """``done`` or ``timeout`` once a series, and ``silent`` for each gap longer than ``quiet_ms``, also one that is still open."""

    def __init__(self, series: str, allowed_ms: int, quiet_ms: int):
        self.series, self.allowed_ms, self.quiet_ms = series, allowed_ms, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # told: an outcome is out; hushed: the silence behind ``last`` is out.
        self.seen = handle.getValueState("seen", _longs("deadline", "last", "told", "hushed"))

    def _rows(self, key, events: list) -> Iterator[pd.DataFrame]:
        if events:
            out = pd.DataFrame(events, columns=["event", "at_ms"])
            out.insert(0, self.series, key[0])
            yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.get()
        at, ready = _in_order(rows, "ms", "good", known[1] if known else None)
        if not len(at):
            return
        events = []
        if known:
            deadline, last, told, hushed = known
        else:
            deadline, last, told, hushed = int(at[0]) + self.allowed_ms, int(at[0]), 0, 0
            self.handle.registerTimer(deadline)
        before = np.r_[last, at[:-1]]
        for i in np.flatnonzero(at - before > self.quiet_ms):
            if i or not hushed:
                events.append(("silent", int(before[i]) + self.quiet_ms))
        hits = at[ready]
        if not told and len(hits) and hits[0] <= deadline:
            events.append(("done", int(hits[0])))
            told = 1
        elif not told and at[-1] > deadline:
            events.append(("timeout", deadline))
            told = 1
        if known and not known[3]:
            self.handle.deleteTimer(last + self.quiet_ms)
            if last + self.quiet_ms == deadline:  # one timer served both
                self.handle.registerTimer(deadline)
        self.handle.registerTimer(int(at[-1]) + self.quiet_ms)
        self.seen.update((deadline, int(at[-1]), told, 0))
        yield from self._rows(key, events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        deadline, last, told, hushed = self.seen.get()
        now, events = expiredTimerInfo.getExpiryTimeInMs(), []
        if now == deadline and not told:
            events.append(("timeout", deadline))
            told = 1
        if now == last + self.quiet_ms and not hushed:
            events.append(("silent", now))
            hushed = 1
        self.seen.update((deadline, last, told, hushed))
        yield from self._rows(key, events)

    def close(self) -> None:
        pass


def deadline_events(samples: DataFrame, series: str, at: str, ready: Column, allowed_ms: int, quiet_ms: int, late: str = "0 seconds") -> DataFrame:
    """(series, event, at_ms) on a stream of samples with a time column ``at``; the counterpart of ``monitor.sync_watch``.

    A series is ``done`` at its first ready sample within ``allowed_ms`` of its first sample, else its deadline is a ``timeout``, raised by a later sample
    or by the watermark. A gap of more than ``quiet_ms`` behind a sample is ``silent``. A ready flag that is unknown is not ready; samples without a series or a time are left
    out. ``late`` is how far behind the newest sample one may come.
    """
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    narrow = samples.select(quoted(series).alias("series"), quoted(at).cast("timestamp").alias("at"), F.coalesce(ready, F.lit(False)).alias("good"))
    narrow = narrow.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    narrow = narrow.filter(F.col("series").isNotNull() & F.col("ms").isNotNull())
    out = [T.StructField(series, samples.schema[series].dataType), T.StructField("event", T.StringType()), T.StructField("at_ms", T.LongType())]
    return narrow.groupBy("series").transformWithStateInPandas(
        statefulProcessor=Deadlines(series, allowed_ms, quiet_ms), outputStructType=T.StructType(out), outputMode="append", timeMode="eventTime"
    )
