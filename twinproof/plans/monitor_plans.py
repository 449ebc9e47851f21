"""Monitoring queries: the event table read as metric samples, orders as sync states.

A sample's series is its user, its order the event id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.functions.scalars import binary_position, is_write_statement
from twinproof.operators import monitor as M
from twinproof.plans.registry import Derived, pick, query, with_ctes
from twinproof.session import shared_dir
from twinproof.sources.reports import read_report, write_report
from twinproof.streaming.watch import watch_slots

SERIES, ORDER = "user_id", "event_id"
_BASE = {"event_id": "event_id", "user_id": "user_id"}

POLLS = Derived(
    "polls",
    "events",
    {
        **_BASE,
        "apply_errors": "CAST(floor(value * 100) AS BIGINT)",
        "sync_errors": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END",
        "ok": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type IN ('view', 'click') END",
        "line": "event_type",
    },
)
_ORDERED = "OVER (PARTITION BY user_id ORDER BY event_id)"


@query(
    "rising_errors",
    with_ctes(POLLS)
    + f""", l AS (SELECT *, lag(apply_errors) {_ORDERED} AS pa, lag(sync_errors) {_ORDERED} AS ps FROM polls)
    SELECT event_id, user_id, pa AS prev_apply, apply_errors,
      coalesce(apply_errors > pa OR sync_errors > ps, false) AS rising FROM l""",
)
def rising_errors(spark: SparkSession, folder: str) -> DataFrame:
    out = M.rising(POLLS.df(spark, folder), ["apply_errors", "sync_errors"], SERIES, ORDER)
    return out.select("event_id", "user_id", F.col("prev_apply_errors").alias("prev_apply"), "apply_errors", "rising")


@query(
    "collapse_repeats",
    with_ctes(POLLS)
    + f""", l AS (SELECT *, lag(line) {_ORDERED} AS p FROM polls)
    SELECT event_id, user_id, line FROM l WHERE p IS DISTINCT FROM line""",
)
def collapse_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return M.collapse_repeats(POLLS.df(spark, folder), "line", SERIES, ORDER).select("event_id", "user_id", "line")


@query(
    "failure_streaks",
    with_ctes(POLLS)
    + f""", i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) {_ORDERED} AS island FROM polls)
    SELECT user_id, count(*) AS failures, min(event_id) AS first, max(event_id) AS last, count(*) >= 5 AS aborts
    FROM i WHERE ok IS NOT TRUE GROUP BY user_id, island""",
)
def failure_streaks(spark: SparkSession, folder: str) -> DataFrame:
    return M.failure_streaks(POLLS.df(spark, folder), SERIES, ORDER)


# Log positions per sample in hexadecimal X/Y form.
SLOTS = Derived(
    "slots",
    "events",
    {
        "sample": "event_id",
        "subscription": "user_id",
        "active": "event_type <> 'error'",
        "wal_status": pick("event_id + user_id", ["reserved", "extended", "unreserved", "reserved", "lost", "extended", None]),
        "current_lsn": "hex(user_id % 8 + 1) || '/' || hex(event_id * 1000 + 5000000)",
        "restart_lsn": "hex(user_id % 8) || '/' || hex(CAST(round(value * 100) AS BIGINT) * 40000)",
        "confirmed_flush_lsn": "hex(user_id % 8 + 1) || '/' || hex(event_id * 1000 + 5000000 - (event_id % 4) * 1024)",
    },
)
_LSN = "(CAST('0x' || split_part({0}, '/', 1) AS BIGINT) * 4294967296 + CAST('0x' || split_part({0}, '/', 2) AS BIGINT))"
_LAGS = f"""lags AS (SELECT *, CAST({_LSN.format("current_lsn")} - {_LSN.format("restart_lsn")} AS BIGINT) AS retained_bytes,
  greatest(0, CAST({_LSN.format("current_lsn")} - {_LSN.format("confirmed_flush_lsn")} AS BIGINT)) AS lag_bytes FROM slots)"""
_RETAINED = """CASE WHEN wal_status = 'lost' THEN 'abort' WHEN retained_bytes / 1048576.0 > 2048 THEN 'abort'
  WHEN wal_status IS NULL OR wal_status NOT IN ('reserved', 'extended') THEN 'warn' ELSE 'ok' END"""


@query(
    "retained_watchdog",
    with_ctes(SLOTS) + f", {_LAGS} SELECT sample, subscription, retained_bytes, lag_bytes, {_RETAINED} AS verdict FROM lags",
)
def retained_watchdog(spark: SparkSession, folder: str) -> DataFrame:
    return watch_slots(SLOTS.df(spark, folder)).select("sample", "subscription", "retained_bytes", "lag_bytes", "verdict")


RETENTION = Derived(
    "retention",
    "events",
    {
        "event_id": "event_id",
        "elapsed_sec": "CAST(floor(value * 100) AS BIGINT)",
        "retention_sec": "CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 0 WHEN 'signup' THEN 3600 "
        "WHEN 'error' THEN 1800 ELSE -1 END",
    },
)


@query(
    "retention_watchdog",
    with_ctes(RETENTION)
    + """SELECT *, CASE WHEN retention_sec IS NULL OR retention_sec <= 0 THEN 'ok'
      WHEN CAST(elapsed_sec AS DOUBLE) / retention_sec >= 1 THEN 'abort'
      WHEN CAST(elapsed_sec AS DOUBLE) / retention_sec >= 0.8 THEN 'warn' ELSE 'ok' END AS verdict FROM retention""",
)
def retention_watchdog(spark: SparkSession, folder: str) -> DataFrame:
    return M.retention_watchdog(RETENTION.df(spark, folder))


STATES = Derived(
    "states",
    "orders",
    {
        "subscription": "o_custkey",
        "state": "CASE WHEN o_custkey % 3 = 0 THEN 'r' WHEN o_orderstatus = 'O' THEN 'r' WHEN o_orderstatus = 'F' THEN 's' "
        "WHEN o_orderpriority = '1-URGENT' THEN 'i' ELSE 'd' END",
    },
)
WORKERS = Derived(
    "workers",
    "events",
    {"subscription": "user_id", "pid": "CASE WHEN event_type = 'error' THEN NULL ELSE event_id END"},
)


@query(
    "sync_status",
    with_ctes(STATES, SLOTS, WORKERS)
    + f""", {_LAGS},
    newest AS (SELECT * FROM lags QUALIFY row_number() OVER (PARTITION BY subscription ORDER BY sample DESC) = 1),
    live AS (SELECT subscription, count(pid) AS workers FROM workers GROUP BY 1),
    roll AS (SELECT subscription, count(*) AS total, count(*) FILTER (WHERE state = 'i') AS init,
      count(*) FILTER (WHERE state = 'd') AS copying, count(*) FILTER (WHERE state = 's') AS synced,
      count(*) FILTER (WHERE state = 'r') AS ready FROM states GROUP BY 1)
    SELECT roll.*, ready = total AS all_ready, newest.subscription IS NOT NULL AS slot_exists,
      coalesce(active, false) AS slot_active, CAST(round(retained_bytes / CAST(1048576 AS DOUBLE)) AS BIGINT) AS retained_mb,
      lag_bytes, coalesce(workers, 0) AS workers
    FROM roll LEFT JOIN newest USING (subscription) LEFT JOIN live USING (subscription)""",
)
def sync_status(spark: SparkSession, folder: str) -> DataFrame:
    return M.status_snapshot(STATES.df(spark, folder), SLOTS.df(spark, folder), WORKERS.df(spark, folder))


EXPECTED_BYTES = Derived("expected", "lineitem", {"subscription": "l_suppkey", "bytes": "CAST(l_quantity AS BIGINT) * 8192"})
COPIED_BYTES = EXPECTED_BYTES.but("copied", where="l_linestatus = 'F' AND l_returnflag = 'R' AND l_linenumber = 1")


@query(
    "copy_progress",
    with_ctes(EXPECTED_BYTES, COPIED_BYTES)
    + """, w AS (SELECT subscription, CAST(sum(bytes) AS BIGINT) AS expected_bytes FROM expected GROUP BY 1),
    h AS (SELECT subscription, CAST(sum(bytes) AS BIGINT) AS copied_bytes FROM copied GROUP BY 1)
    SELECT subscription, expected_bytes, coalesce(copied_bytes, 0) AS copied_bytes,
      CAST(floor(coalesce(copied_bytes, 0) * 100 / CAST(nullif(expected_bytes, 0) AS DOUBLE) + 0.5) AS BIGINT) AS percent
    FROM w LEFT JOIN h USING (subscription)""",
)
def copy_progress(spark: SparkSession, folder: str) -> DataFrame:
    return M.copy_progress(EXPECTED_BYTES.df(spark, folder), COPIED_BYTES.df(spark, folder))


STOPS = Derived(
    "stops",
    "events",
    {
        "user_id": "user_id",
        "position": "CASE WHEN user_id % 6 = 0 AND event_type = 'error' THEN NULL WHEN user_id % 3 = 0 THEN 500 ELSE event_id END",
        "query": "CASE event_type WHEN 'view' THEN 'SELECT 1' WHEN 'click' THEN '  show x' WHEN 'signup' THEN 'INSERT INTO t' "
        "WHEN 'error' THEN 'update t set a = 1' ELSE 'Copy t to stdout' END",
    },
)
_READS = "regexp_matches(query, '^\\s*(select|copy|with|show|set|start_replication|fetch)', 'i')"
_STOP_SQL = f"""stop AS (SELECT user_id, count(*) AS samples, min(position) AS first_position, max(position) AS last_position,
  count(*) FILTER (WHERE NOT {_READS}) AS write_sessions, count(position) AS known FROM stops GROUP BY 1)"""
_STOPPED = "coalesce(samples > 1 AND known = samples AND first_position = last_position, false) AS stopped"


@query(
    "write_stop_gate",
    with_ctes(STOPS) + f", {_STOP_SQL} SELECT * EXCLUDE (known), {_STOPPED} FROM stop",
)
def write_stop_gate(spark: SparkSession, folder: str) -> DataFrame:
    return M.write_stop_gate(STOPS.df(spark, folder), "user_id", "position", is_write_statement(F.col("query")))


@query(
    "write_sessions",
    with_ctes(STOPS) + f"SELECT user_id, count(*) AS sessions FROM stops WHERE NOT {_READS} GROUP BY 1",
)
def write_sessions(spark: SparkSession, folder: str) -> DataFrame:
    sessions = STOPS.df(spark, folder).filter(is_write_statement(F.col("query")))
    return sessions.groupBy("user_id").agg(F.count("*").alias("sessions"))


DRAIN = Derived(
    "drain",
    "events",
    {"source": "user_id", "day": "CAST(ts AS DATE)", "lag_bytes": "CAST(floor(value) AS BIGINT) * 1024 - user_id * 10"},
)
SOURCES = Derived("sources", "customer", {"source": "c_custkey"})
_DEADLINE = "2024-01-20"


@query(
    "lag_drain",
    with_ctes(DRAIN, SOURCES)
    + f""", s AS (SELECT source, min(day) FILTER (WHERE lag_bytes <= 0 AND day <= DATE '{_DEADLINE}') AS drained_at,
      count(*) AS samples FROM drain GROUP BY 1)
    SELECT source, drained_at, coalesce(samples, 0) AS samples, drained_at IS NOT NULL AS drained
    FROM sources LEFT JOIN s USING (source)""",
)
def lag_drain(spark: SparkSession, folder: str) -> DataFrame:
    return M.lag_drain(SOURCES.df(spark, folder), DRAIN.df(spark, folder), "source", "day", F.lit(_DEADLINE).cast("date"))


SYNC = Derived(
    "sync",
    "events",
    {
        **_BASE,
        "tables": "CASE WHEN user_id % 11 = 0 THEN 0 ELSE user_id % 7 + 1 END",
        "ready": "CASE WHEN user_id % 5 = 0 THEN 0 WHEN value > 40 THEN user_id % 7 + 1 ELSE 1 END",
        "workers": "CASE WHEN event_type = 'error' THEN 0 ELSE 1 END",
    },
)


@query(
    "sync_watch",
    with_ctes(SYNC)
    + f""", n AS (SELECT *, row_number() {_ORDERED} AS poll FROM sync),
    a AS (SELECT user_id, count(*) AS polls, count(*) FILTER (WHERE poll > 1 AND workers = 0) AS no_worker,
      count(*) FILTER (WHERE poll > 4 AND tables = 0) AS no_tables,
      min(event_id) FILTER (WHERE tables > 0 AND ready = tables) AS ready_at, max(event_id) AS last_sample FROM n GROUP BY 1)
    SELECT *, CASE WHEN ready_at <= 900 + user_id THEN 'done' WHEN last_sample > 900 + user_id THEN 'timeout' ELSE 'waiting' END AS outcome
    FROM a""",
)
def sync_watch(spark: SparkSession, folder: str) -> DataFrame:
    return M.sync_watch(SYNC.df(spark, folder), SERIES, ORDER, F.col("user_id") + 900)


HEALTH = Derived(
    "health",
    "events",
    {
        **_BASE,
        "body": "CASE WHEN event_type = 'error' OR (user_id % 4 = 0 AND event_type IN ('signup', 'purchase')) THEN NULL "
        "WHEN user_id % 10 = 1 AND event_type = 'click' AND value > 50 THEN '<html>gateway</html>' "
        """WHEN user_id % 10 = 2 AND value > 80 THEN '{"status":"UP","checks":[{"name":"debezium","status":"DOWN"}]}' """
        """WHEN user_id % 10 = 3 THEN '{"status":"UP"}' """
        """ELSE '{"status":"DOWN","checks":[{"name":"disk","status":"DOWN"},{"name":"debezium","status":"UP"}]}' END""",
    },
)


@query(
    "health_watch",
    with_ctes(HEALTH)
    + f""", t AS (SELECT *, body IS NOT NULL AND (body LIKE '<html>%' OR body LIKE '%debezium","status":"DOWN"%') AS is_down FROM health),
    i AS (SELECT *, sum(CASE WHEN body IS NOT NULL THEN 1 ELSE 0 END) {_ORDERED} AS island FROM t),
    s AS (SELECT user_id, max(c) AS outage FROM (SELECT user_id, island, count(*) AS c FROM i WHERE body IS NULL GROUP BY 1, 2) GROUP BY 1),
    a AS (SELECT user_id, count(*) AS probes, count(*) FILTER (WHERE is_down) AS down FROM t GROUP BY 1)
    SELECT user_id, probes, down, coalesce(outage, 0) AS longest_outage,
      CASE WHEN down > 0 THEN 'connector down' WHEN coalesce(outage, 0) >= 5 THEN 'unreachable' ELSE 'ok' END AS verdict
    FROM a LEFT JOIN s USING (user_id)""",
)
def health_watch(spark: SparkSession, folder: str) -> DataFrame:
    return M.health_watch(HEALTH.df(spark, folder), SERIES, ORDER)


MARKS = Derived("marks", "events", {"event_id": "event_id", "value": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END"})


@query("binary_positions", with_ctes(MARKS) + "SELECT event_id, coalesce(lower(hex(value)), 'NULL') AS position FROM marks")
def binary_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Binary positions as text that orders and compares like them."""
    return MARKS.df(spark, folder).select("event_id", binary_position(F.col("value").cast("binary")).alias("position"))


SIGNED = Derived(
    "signed", "customer", {"user_id": "c_custkey", "signed_off": "CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE c_acctbal > 0 END"}
)
COUNTS = Derived(
    "counts",
    "orders",
    {
        "user_id": "o_custkey",
        "source_rows": "o_orderkey",
        "target_rows": "CASE WHEN o_orderkey % 40 = 0 THEN o_orderkey - 1 WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderkey END",
        "source_pos": "o_orderkey",
        "applied_pos": "CASE WHEN o_custkey % 9 = 0 THEN o_orderkey - 1 WHEN o_custkey % 11 = 0 THEN NULL ELSE o_orderkey END",
    },
)


@query(
    "cutover_gate",
    with_ctes(SIGNED, STOPS, COUNTS)
    + f""", {_STOP_SQL}, w AS (SELECT user_id, {_STOPPED} FROM stop),
    c AS (SELECT user_id, bool_and(coalesce(source_rows = target_rows AND applied_pos >= source_pos, false)) AS converged FROM counts GROUP BY 1),
    g AS (SELECT user_id, coalesce(signed_off, false) AS signed_off, coalesce(stopped, false) AS stopped,
      coalesce(converged, false) AS converged FROM signed LEFT JOIN w USING (user_id) LEFT JOIN c USING (user_id))
    SELECT *, signed_off AND stopped AND converged AS pass FROM g""",
)
def cutover_gate(spark: SparkSession, folder: str) -> DataFrame:
    stops = M.write_stop_gate(STOPS.df(spark, folder), "user_id", "position")
    return M.cutover_gate(SIGNED.df(spark, folder), stops, COUNTS.df(spark, folder), "user_id")


PHASE_EVENTS = Derived(
    "phase_events",
    "lineitem",
    {
        "run": "l_orderkey",
        "phase": "CASE l_linenumber WHEN 1 THEN 'preflight' WHEN 2 THEN 'replicate' WHEN 3 THEN 'watch' "
        "WHEN 4 THEN 'reconcile' ELSE 'cutover' END",
        "ok": "CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE NOT (l_returnflag = 'R' AND l_linestatus = 'F') END",
        "ms": "CAST(l_quantity AS BIGINT)",
    },
)
_PH = "['preflight', 'replicate', 'watch', 'reconcile', 'cutover']"


@query(
    "phase_summary",
    with_ctes(PHASE_EVENTS)
    + f""", p AS (SELECT run, list_position({_PH}, phase) - 1 AS i, bool_and(coalesce(ok, false)) AS ok, sum(ms) AS ms FROM phase_events GROUP BY ALL),
    f AS (SELECT run, min(i) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE ok) AS oks FROM p GROUP BY 1),
    t AS (SELECT p.run, sum(ms) AS total FROM p JOIN f ON p.run = f.run AND p.i <= coalesce(failed, 5) GROUP BY 1),
    o AS (SELECT run, count(*) AS n FROM p JOIN f USING (run) WHERE ok AND i < coalesce(failed, 5) GROUP BY 1)
    SELECT f.run, CASE WHEN f.run % 50 = 0 THEN 0 ELSE coalesce(o.n, 0) END AS phases_ok,
      CASE WHEN f.run % 50 = 0 THEN 'unconfirmed' WHEN failed IS NOT NULL THEN {_PH}[failed + 1] END AS failed_phase,
      CAST(CASE WHEN f.run % 50 = 0 THEN 0 ELSE total END AS BIGINT) AS total_ms,
      f.run % 50 <> 0 AND failed IS NULL AND oks = 5 AS ok
    FROM f JOIN t USING (run) LEFT JOIN o USING (run)""",
)
def phase_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Runs that stop at their first failed phase; every 50th run lacks the confirmation."""
    with_flag = PHASE_EVENTS.df(spark, folder)
    return M.phase_summary(with_flag, "run", confirmed=F.col("run") % 50 != 0)


@query(
    "phase_events",
    with_ctes(PHASE_EVENTS)
    + f""", p AS (SELECT *, CAST(list_position({_PH}, phase) - 1 AS INTEGER) AS seq FROM phase_events),
    f AS (SELECT run, min(seq) FILTER (WHERE ok IS NOT TRUE) AS failed FROM p GROUP BY 1)
    SELECT p.* FROM p JOIN f USING (run) WHERE failed IS NULL OR seq <= failed""",
)
def phase_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event log of each run up to its first failure, through the JSON-lines sink."""
    events = M.stop_at_failure(PHASE_EVENTS.df(spark, folder), "run")
    return read_report(spark, write_report(events, shared_dir(spark, "phases")), events.schema)
