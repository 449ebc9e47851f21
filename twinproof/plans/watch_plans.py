"""Queries on keyed watches, kept fingerprints and images as VARIANT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.operators import variants as V
from twinproof.plans.monitor_plans import ORDER, POLLS, SERIES
from twinproof.plans.registry import Derived, query, with_ctes
from twinproof.plans.stream_plans import CHANGES, KEYS, SNAPSHOT
from twinproof.session import shared_dir
from twinproof.sources.tables import load
from twinproof.streaming.apply import read_landed
from twinproof.streaming.prints import PrintStore, compare_sums, drill_stores
from twinproof.streaming.watch import deadline_events, streak_events


def _run(stream: DataFrame, out: str, offsets: str) -> None:
    """Everything that has landed, one file set after the other."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()


# -- keyed watches ---------------------------------------------------------------------------------


@query(
    "watch_streaks",
    with_ctes(POLLS)
    + """, i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM polls),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS nth FROM i WHERE ok IS NOT TRUE),
    m AS (SELECT user_id, max(island) AS open_island FROM i GROUP BY user_id),
    s AS (SELECT user_id, island, count(*) AS failures, min(event_id) AS first, max(event_id) AS last FROM f GROUP BY 1, 2)
    SELECT user_id, 'abort' AS event, CAST(5 AS BIGINT) AS failures, first, event_id AS last FROM f JOIN s USING (user_id, island) WHERE nth = 5
    UNION ALL SELECT user_id, 'ended', failures, first, last FROM s JOIN m USING (user_id) WHERE island < open_island""",
)
def watch_streaks(spark: SparkSession, folder: str) -> DataFrame:
    """Failure streaks as a running watch: polls land in three parts, one of them twice, and the query restarts between them."""
    landing, offsets, out = (shared_dir(spark, name) for name in ("landing", "offsets", "events"))
    polls = POLLS.df(spark, folder).select(SERIES, ORDER, "ok")
    last = load(spark, folder, "events").agg(F.max("event_id")).first()[0]
    cuts = [-1, last // 3, last * 2 // 3, last]
    for above, upto in (*zip(cuts, cuts[1:]), (cuts[1], cuts[2])):
        polls.filter(f"event_id > {above} AND event_id <= {upto}").write.mode("append").parquet(landing)
        _run(streak_events(read_landed(spark, landing, polls.schema), SERIES, ORDER), out, offsets)
    return spark.read.parquet(out)


_HOUR = 3_600_000
_ALLOWED, _QUIET, _LATE = 72 * _HOUR + 7, 30 * _HOUR + 11, 600_000
PROGRESS = Derived(
    "progress",
    "events",
    {"user_id": "user_id", "event_id": "event_id", "ts": "ts", "ready": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type = 'signup' AND user_id % 3 <> 0 END"},
)


@query(
    "watch_deadlines",
    with_ctes(PROGRESS)
    + f""", p AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS ms, max(coalesce(ready, false)) OVER (PARTITION BY user_id, epoch_us(ts) // 1000) AS ready FROM progress),
    w AS (SELECT max(ms) - {_LATE} AS mark FROM p),
    a AS (SELECT user_id, min(ms) + {_ALLOWED} AS deadline, max(ms) AS last, min(ms) FILTER (WHERE ready) AS ready_at FROM p GROUP BY user_id),
    g AS (SELECT user_id, ms, lead(ms) OVER (PARTITION BY user_id ORDER BY ms) AS next FROM p)
    SELECT user_id, CASE WHEN ready_at <= deadline THEN 'done' ELSE 'timeout' END AS event, CASE WHEN ready_at <= deadline THEN ready_at ELSE deadline END AS at_ms
      FROM a, w WHERE ready_at <= deadline OR last > deadline OR mark > deadline
    UNION ALL SELECT user_id, 'silent', ms + {_QUIET} FROM g, w WHERE coalesce(next, mark) > ms + {_QUIET}""",
)
def watch_deadlines(spark: SparkSession, folder: str) -> DataFrame:
    """Deadlines and silence by event time, over samples that land in four parts; timers speak for series that send nothing more."""
    landing, offsets, out = (shared_dir(spark, name) for name in ("landing", "offsets", "events"))
    rows = PROGRESS.df(spark, folder)
    first, last = rows.agg(F.min(F.unix_millis(F.col("ts").cast("timestamp"))), F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    for i in range(4):
        low, high = first + (last - first) * i // 4, first + (last - first) * (i + 1) // 4
        part = rows.filter((ms > low) & (ms <= high)) if i else rows.filter(ms <= high)
        part.write.mode("append").parquet(landing)
        _run(deadline_events(read_landed(spark, landing, rows.schema), SERIES, "ts", F.col("ready"), _ALLOWED, _QUIET, f"{_LATE // 1000} seconds"), out, offsets)
    return spark.read.parquet(out)


# -- kept fingerprints --------------------------------------------------------------------------------

_COLUMNS = ["user_id", "event_type", "cents", "props"]
_STATE = """{name} AS (WITH c AS (SELECT * FROM changes WHERE {where}), l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) = 1)
  SELECT user_id, event_type, cents, props FROM snap WHERE user_id NOT IN (SELECT user_id FROM l) UNION ALL SELECT user_id, event_type, cents, props FROM l WHERE op <> 'd')"""


@query(
    "reconcile_incremental",
    with_ctes(CHANGES, SNAPSHOT)
    + ", "
    + _STATE.format(name="src", where="true")
    + ", "
    + _STATE.format(name="tgt", where="pos % 7 <> 0")
    + """, d AS (SELECT coalesce(s.user_id, t.user_id) AS id,
      CASE WHEN t.user_id IS NULL THEN 'missing_on_target' WHEN s.user_id IS NULL THEN 'extra_on_target' ELSE 'hash_diff' END AS kind
      FROM src s FULL JOIN tgt t ON s.user_id = t.user_id WHERE s.user_id IS NULL OR t.user_id IS NULL
        OR (s.event_type, s.cents, s.props) IS DISTINCT FROM (t.event_type, t.cents, t.props))
    SELECT kind, CAST(id AS VARCHAR) AS pk, CAST(NULL AS BIGINT) AS rows FROM d
    UNION ALL SELECT 'source_rows', NULL, count(*) FROM src UNION ALL SELECT 'target_rows', NULL, count(*) FROM tgt""",
)
def reconcile_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Two copies fingerprinted once and brought forward by three batches of changes, of which the target lost every seventh."""
    rows, changes = SNAPSHOT.df(spark, folder), CHANGES.df(spark, folder)
    last = load(spark, folder, "events").agg(F.max("event_id")).first()[0]
    stores = [PrintStore(shared_dir(spark, side), KEYS, _COLUMNS, buckets=16) for side in ("source-prints", "target-prints")]
    cuts = [-1, last // 4, last * 3 // 4, last]
    for store, seen in zip(stores, (changes, changes.filter("pos % 7 <> 0"))):
        store.create(spark, rows)
        for batch, (above, upto) in enumerate(zip(cuts, cuts[1:]), 1):
            store.advance(spark, seen.filter(f"pos > {above} AND pos <= {upto}"), batch)
    report = compare_sums(spark, *stores)
    totals = report.agg(F.sum("source_rows").alias("source_rows"), F.sum("target_rows").alias("target_rows"))
    totals = totals.select(F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.lit(None).cast("string").alias("pk"), F.col(c).alias("rows")) for c in ("source_rows", "target_rows")])))
    return drill_stores(spark, *stores).select("kind", "pk", F.lit(None).cast("bigint").alias("rows")).unionByName(totals)


# -- images as VARIANT ----------------------------------------------------------------------------------

_CENTS = "CAST(round(value * 100) AS BIGINT)"
NESTED = Derived(
    "nested",
    "events",
    {
        "pos": "event_id",
        "user_id": "user_id",
        "kind": "event_type",
        "cents": _CENTS,
        "image": """CASE WHEN event_id % 19 = 0 THEN '{"user_id":' WHEN event_id % 23 = 0 THEN '[1]' ELSE
        '{"user_id":' || user_id || ',"at":{"kind":"' || event_type || '"' || CASE WHEN event_id % 5 = 0 THEN ',"cents":' || """
        + _CENTS
        + """ ELSE '' END || '}' || CASE WHEN event_id % 7 = 0 THEN ',"extra tag":{"a":"x' || (event_id % 3) || '"}' ELSE '' END || '}' END""",
    },
)


@query(
    "cdc_variant_drift",
    with_ctes(NESTED)
    + """, ok AS (SELECT * FROM nested WHERE pos % 19 <> 0 AND pos % 23 <> 0)
    SELECT 'field' AS part, 'at.cents' AS item, min(pos) AS pos, count(*) AS n FROM ok WHERE pos % 5 = 0
    UNION ALL SELECT 'field', 'extra tag', min(pos), count(*) FROM ok WHERE pos % 7 = 0
    UNION ALL SELECT 'rejected', 'malformed image', min(pos), count(*) FROM nested WHERE pos % 19 = 0 OR pos % 23 = 0
    UNION ALL SELECT 'replayed', kind || ' x' || (pos % 3), pos, cents FROM ok WHERE pos % 35 = 0""",
)
def cdc_variant_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Fields that the schema lacks, at two depths: found, counted, kept through a written table and read after the schema is widened."""
    declared = T.StructType.fromDDL("user_id bigint, at struct<kind: string>")
    path = shared_dir(spark, "variants")
    V.as_variant(NESTED.df(spark, folder).select("pos", F.col("image").alias("text")), "text").write.parquet(path)
    images = spark.read.parquet(path)
    good, bad = images.filter("reason IS NULL"), images.filter("reason IS NOT NULL")
    fields = V.unknown_fields(good, declared).select(F.lit("field").alias("part"), F.col("path").alias("item"), F.col("first_pos").alias("pos"), F.col("images").alias("n"))
    rejected = bad.groupBy("reason").agg(F.min("pos").alias("pos"), F.count("*").alias("n")).select(F.lit("rejected").alias("part"), F.col("reason").alias("item"), "pos", "n")
    wider = T.StructType.fromDDL("user_id bigint, at struct<kind: string, cents: bigint>, `extra tag` struct<a: string>")
    opened = V.open_variant(good, wider).filter("at.cents IS NOT NULL AND `extra tag` IS NOT NULL AND size(misfit) = 0")
    item = F.concat_ws(" ", "at.kind", F.col("`extra tag`.a"))
    return fields.unionByName(rejected).unionByName(opened.select(F.lit("replayed").alias("part"), item.alias("item"), "pos", F.col("at.cents").alias("n")))
