"""Replication monitoring over metric samples: roll-ups, watchdogs, streaks and gates.

Long series are cut into pieces (see ``functions.ordered``), so a subscription that holds most of
the samples still spreads over many tasks. Gates fail closed: no sample means not passed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.functions.ordered import with_previous, with_running_count
from twinproof.functions.scalars import clamp, health_is_up, lsn_position, megabytes, retained_verdict, retention_verdict

# Sync states (init, copying, synced, ready) and run phases in order.
STATES = {"i": "init", "d": "copying", "s": "synced", "r": "ready"}
PHASES = ("preflight", "replicate", "watch", "reconcile", "cutover")
MAX_FAILURES = 5


def sync_rollup(states: DataFrame, by: Sequence[str] = ("subscription",)) -> DataFrame:
    """Counts per sync state; ready only when there is at least one table and all are ready."""
    counts = [F.count_if(F.col("state") == code).alias(name) for code, name in STATES.items()]
    return (
        states.groupBy(*by)
        .agg(F.count("*").alias("total"), *counts)
        .withColumn("all_ready", (F.col("total") > 0) & (F.col("ready") == F.col("total")))
    )


def slot_lag(samples: DataFrame) -> DataFrame:
    """Retained and unconfirmed bytes per sample, from the three log positions."""
    now = lsn_position(F.col("current_lsn"))
    retained = (now - lsn_position(F.col("restart_lsn"))).cast("bigint")
    lag = (now - lsn_position(F.col("confirmed_flush_lsn"))).cast("bigint")
    return samples.withColumn("retained_bytes", retained).withColumn("lag_bytes", clamp(lag))


def status_snapshot(states: DataFrame, slots: DataFrame, workers: DataFrame) -> DataFrame:
    """Latest status per subscription: table states, slot size and lag, live workers.

    ``slots``: (subscription, sample, active, the three positions); the newest sample counts.
    A subscription without a slot row stays in the result with a null slot.
    """
    newest = (
        slot_lag(slots)
        .groupBy("subscription")
        .agg(F.max_by(F.struct("active", "retained_bytes", "lag_bytes"), "sample").alias("slot"))
    )
    live = workers.groupBy("subscription").agg(F.count("pid").alias("workers"))
    return (
        sync_rollup(states)
        .join(newest, "subscription", "left")
        .join(live, "subscription", "left")
        .select(
            "subscription",
            "total",
            *STATES.values(),
            "all_ready",
            F.col("slot").isNotNull().alias("slot_exists"),
            F.coalesce(F.col("slot.active"), F.lit(False)).alias("slot_active"),
            megabytes(F.col("slot.retained_bytes")).alias("retained_mb"),
            F.col("slot.lag_bytes").alias("lag_bytes"),
            F.coalesce("workers", F.lit(0)).alias("workers"),
        )
    )


def copy_progress(expected: DataFrame, copied: DataFrame) -> DataFrame:
    """Copied against expected bytes per subscription; the ratio is null with nothing expected."""
    want = expected.groupBy("subscription").agg(F.sum("bytes").alias("expected_bytes"))
    have = copied.groupBy("subscription").agg(F.sum("bytes").alias("copied_bytes"))
    out = want.join(have, "subscription", "left").withColumn("copied_bytes", F.coalesce("copied_bytes", F.lit(0)))
    percent = F.floor(F.col("copied_bytes") * 100 / F.nullif("expected_bytes", F.lit(0)) + 0.5).cast("bigint")
    return out.withColumn("percent", percent)


def rising(samples: DataFrame, counters: Sequence[str], series: str, order: str) -> DataFrame:
    """Samples on which any counter grew since the previous sample; the first never counts."""
    prev = with_previous(samples, [series], order, counters)
    grew = F.lit(False)
    for c in counters:
        grew = grew | F.coalesce(F.col(c) > F.col(f"prev_{c}"), F.lit(False))
    return prev.withColumn("rising", F.col("has_prev") & grew)


def collapse_repeats(log: DataFrame, line: str, series: str, order: str) -> DataFrame:
    """Drop a line equal to the one directly before it in the same series."""
    prev = with_previous(log, [series], order, [line])
    same = F.col("has_prev") & F.col(line).eqNullSafe(F.col(f"prev_{line}"))
    return prev.filter(~same).drop("has_prev", f"prev_{line}")


def failure_streaks(
    polls: DataFrame, series: str, order: str, ok: str = "ok", limit: int = MAX_FAILURES
) -> DataFrame:
    """Runs of failed polls: length, first and last position, and whether the run aborts.

    Failures between the same two clean polls share the running count of clean polls. A poll whose result is unknown has failed.
    """
    clean = F.coalesce(F.col(ok), F.lit(False))
    islands = with_running_count(polls, [series], order, clean, "_island")
    return (
        islands.filter(~clean)
        .groupBy(series, "_island")
        .agg(F.count("*").alias("failures"), F.min(order).alias("first"), F.max(order).alias("last"))
        .withColumn("aborts", F.col("failures") >= limit)
        .drop("_island")
    )


def write_stop_gate(samples: DataFrame, source: str, position: str, writers: Column | None = None) -> DataFrame:
    """Position unchanged over the samples of a window: writes look stopped.

    At least two samples are needed, and every one must know its position. ``writers`` counts write-shaped sessions for the report.
    """
    n_writers = F.count_if(writers) if writers is not None else F.lit(0).cast("bigint")
    return (
        samples.groupBy(source)
        .agg(
            F.count("*").alias("samples"),
            F.min(position).alias("first_position"),
            F.max(position).alias("last_position"),
            n_writers.alias("write_sessions"),
            F.count(position).alias("_known"),
        )
        .withColumn(
            "stopped",
            F.coalesce(
                (F.col("samples") > 1) & (F.col("_known") == F.col("samples")) & (F.col("first_position") == F.col("last_position")), F.lit(False)
            ),
        )
        .drop("_known")
    )


def lag_drain(expected: DataFrame, samples: DataFrame, source: str, order: str, deadline: Column) -> DataFrame:
    """First sample before the deadline with no lag left; sources without one are not drained."""
    hit = (F.col("lag_bytes") <= 0) & (F.col(order) <= deadline)
    seen = samples.groupBy(source).agg(
        F.min(F.when(hit, F.col(order))).alias("drained_at"), F.count("*").alias("samples")
    )
    return (
        expected.select(source)
        .distinct()
        .join(seen, source, "left")
        .withColumn("samples", F.coalesce("samples", F.lit(0)))
        .withColumn("drained", F.col("drained_at").isNotNull())
    )


def retained_watchdog(samples: DataFrame, max_mb: float = 2048) -> DataFrame:
    return samples.withColumn("verdict", retained_verdict(F.col("retained_bytes"), F.col("wal_status"), max_mb))


def retention_watchdog(samples: DataFrame, warn_fraction: float = 0.8) -> DataFrame:
    return samples.withColumn(
        "verdict", retention_verdict(F.col("elapsed_sec"), F.col("retention_sec"), warn_fraction)
    )


def sync_watch(
    samples: DataFrame, series: str, order: str, deadline: Column, quiet_polls: int = 3
) -> DataFrame:
    """Outcome of watching one subscription's samples (tables, ready, workers per sample).

    ``no_worker`` skips the first poll; ``no_tables`` needs more than ``quiet_polls`` earlier
    ones. Done is the first all-ready sample; otherwise a sample past the deadline times out.
    """
    numbered = with_running_count(samples, [series], order, F.lit(True), "poll")
    ready = (F.col("tables") > 0) & (F.col("ready") == F.col("tables"))
    out = numbered.groupBy(series).agg(
        F.count("*").alias("polls"),
        F.count_if((F.col("poll") > 1) & (F.col("workers") == 0)).alias("no_worker"),
        F.count_if((F.col("poll") > quiet_polls + 1) & (F.col("tables") == 0)).alias("no_tables"),
        F.min(F.when(ready, F.col(order))).alias("ready_at"),
        F.max(order).alias("last_sample"),
    )
    outcome = (
        F.when(F.col("ready_at").isNotNull() & (F.col("ready_at") <= deadline), "done")
        .when(F.col("last_sample") > deadline, "timeout")
        .otherwise("waiting")
    )
    return out.withColumn("outcome", outcome)


def health_watch(
    probes: DataFrame, series: str, order: str, body: str = "body", limit: int = MAX_FAILURES
) -> DataFrame:
    """Connector verdict: a reachable DOWN aborts, as does a run of unreachable probes."""
    _, named = health_is_up(F.col(body))
    tagged = probes.withColumn("_reached", F.col(body).isNotNull()).withColumn("_down", F.col(body).isNotNull() & ~named)
    # Unreachable probes between two answers share the running count of answers.
    islands = with_running_count(tagged, [series], order, F.col("_reached"), "_island")
    return (
        islands.groupBy(series, "_island")
        .agg(F.count("*").alias("n"), F.count_if("_down").alias("d"), F.count_if(~F.col("_reached")).alias("o"))
        .groupBy(series)
        .agg(F.sum("n").alias("probes"), F.sum("d").alias("down"), F.max("o").alias("longest_outage"))
        .withColumn(
            "verdict",
            F.when(F.col("down") > 0, "connector down")
            .when(F.col("longest_outage") >= limit, "unreachable")
            .otherwise("ok"),
        )
    )


def cutover_gate(signed: DataFrame, stops: DataFrame, counts: DataFrame, source: str) -> DataFrame:
    """All of: schema signed off, write-stop seen, counts converged and positions applied.

    Every source of ``signed`` gets a row; whatever is absent from the other inputs fails.
    """
    stopped = stops.select(source, "stopped")
    converged = counts.groupBy(source).agg(
        F.bool_and(
            # A table with an unknown count or position has not converged; the aggregate alone would skip it.
            F.coalesce((F.col("source_rows") == F.col("target_rows")) & (F.col("applied_pos") >= F.col("source_pos")), F.lit(False))
        ).alias("converged")
    )
    no = F.lit(False)
    out = (
        signed.join(stopped, source, "left")
        .join(converged, source, "left")
        .withColumn("signed_off", F.coalesce("signed_off", no))
        .withColumn("stopped", F.coalesce("stopped", no))
        .withColumn("converged", F.coalesce("converged", no))
    )
    return out.withColumn("pass", F.col("signed_off") & F.col("stopped") & F.col("converged"))


def phases_through(through: str) -> list[str]:
    """The phases to run, up to and including one."""
    if through not in PHASES:
        raise ValueError(f"unknown phase {through!r}, valid: {', '.join(PHASES)}")
    return list(PHASES[: PHASES.index(through) + 1])


def phase_summary(
    results: DataFrame, run: str, through: str = "cutover", confirmed: Column | None = None
) -> DataFrame:
    """Per run: how far it got, the phase that failed first, and the overall result.

    ``results``: (run, phase, ok, ms). Repeated attempts of a phase add up, and one failed
    attempt fails it. Phases after the first failure do not count. A run that reaches cutover
    without confirmation is refused before its first phase.
    """
    order = F.coalesce(*[F.when(F.col("phase") == p, F.lit(i)) for i, p in enumerate(PHASES)])
    plan = phases_through(through)
    attempts = (
        results.withColumn("_i", order)
        .filter(F.col("_i") < len(plan))
        .groupBy(run, "_i")
        .agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"), F.sum("ms").alias("ms"))
    )
    # At most one row per phase and run is left to collect.
    out = (
        attempts.groupBy(run)
        .agg(
            F.min(F.when(~F.col("ok"), F.col("_i"))).alias("_failed"),
            F.collect_list(F.when(F.col("ok"), F.col("_i"))).alias("_done"),
            F.collect_list(F.struct("_i", "ms")).alias("_ms"),
        )
        .withColumn("_stop", F.coalesce("_failed", F.lit(len(plan))))
    )
    refused = ~confirmed if confirmed is not None and through == "cutover" else F.lit(False)
    name = F.element_at(F.array(*[F.lit(p) for p in PHASES]), F.col("_failed") + 1)
    return out.select(
        run,
        F.when(refused, F.lit(0)).otherwise(
            F.size(F.filter("_done", lambda i: i < F.col("_stop")))
        ).cast("bigint").alias("phases_ok"),
        F.when(refused, F.lit("unconfirmed")).otherwise(F.when(F.col("_failed").isNotNull(), name)).alias("failed_phase"),
        F.when(refused, F.lit(0).cast("bigint")).otherwise(
            F.aggregate(
                F.filter("_ms", lambda s: s["_i"] <= F.col("_stop")),
                F.lit(0).cast("bigint"),
                lambda acc, s: acc + s["ms"],
            )
        ).alias("total_ms"),
        (~refused & F.col("_failed").isNull() & (F.size("_done") == len(plan))).alias("ok"),
    )


def stop_at_failure(results: DataFrame, run: str) -> DataFrame:
    """Phase events of a run up to its first failure, as JSON-ready rows. An unknown result is a failure."""
    order = F.coalesce(*[F.when(F.col("phase") == p, F.lit(i)) for i, p in enumerate(PHASES)])
    tagged = results.withColumn("seq", order)
    first = tagged.filter(~F.coalesce("ok", F.lit(False))).groupBy(run).agg(F.min("seq").alias("_failed"))
    return (
        tagged.join(first, run, "left")
        .filter(F.col("_failed").isNull() | (F.col("seq") <= F.col("_failed")))
        .drop("_failed")
    )
