"""Change-apply queries over the event table read as an ordered change stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.functions.scalars import binlog_position
from twinproof.operators import changes as C
from twinproof.operators.loadgen import audit, churn
from twinproof.plans.registry import Derived, query, with_ctes
from twinproof.session import shared_dir
from twinproof.sources.tables import load
from twinproof.streaming.apply import ChangeRouter, ChangeTable, latest_state, read_landed

KEYS = ["user_id"]

# Events as changes of a keyed table: sign-ups insert, errors delete, the rest update.
CHANGES = Derived(
    "changes",
    "events",
    {
        "pos": "event_id",
        "user_id": "user_id",
        "op": "CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END",
        "event_type": "event_type",
        "cents": "CAST(round(value * 100) AS BIGINT)",
        "props": "props",
    },
)
# The table before the stream: one row per customer.
SNAPSHOT = Derived(
    "snap",
    "customer",
    {
        "user_id": "c_custkey",
        "event_type": "c_mktsegment",
        "cents": "CAST(round(c_acctbal * 100) AS BIGINT)",
        "props": "c_name",
    },
)
TOPICS = Derived(
    "topics",
    "events",
    {
        "pos": "event_id",
        "topic": "CASE WHEN event_type = 'error' THEN 'other.shop.dead' WHEN event_type = 'signup' "
        "THEN 'dbz.shop.users' ELSE 'dbz.shop.' || event_type || 's' END",
        "topic4": "'dbz.shop.dbo.' || event_type || 's'",
    },
)

_COLS = "user_id, event_type, cents, props"
_MERGED = """SELECT {cols} FROM snap s WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.user_id = s.user_id)
  UNION ALL SELECT {cols} FROM latest WHERE op <> 'd'""".format(cols=_COLS)
_LATEST = "latest AS (SELECT * FROM changes {where} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) = 1)"
_AFTER_MARK = "WHERE pos > (SELECT max(event_id) // 4 FROM events)"
_STATE_SQL = with_ctes(CHANGES, SNAPSHOT) + ", " + _LATEST.format(where=_AFTER_MARK) + _MERGED
_ALL_SQL = with_ctes(CHANGES, SNAPSHOT) + ", " + _LATEST.format(where="") + _MERGED


def _mark(spark: SparkSession, folder: str, share: int = 4) -> Column:
    """Position recorded with the snapshot, as a scalar subquery."""
    last = load(spark, folder, "events").agg(F.max("event_id")).scalar()
    return F.call_function("div", last, F.lit(share))


def _half(spark: SparkSession, folder: str) -> int:
    """Where a landing is split in two."""
    return load(spark, folder, "events").agg(F.max("event_id")).first()[0] // 2


@query("cdc_apply", _STATE_SQL)
def cdc_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot plus the changes after its position: latest per key, upsert or delete."""
    return C.apply_changes(
        SNAPSHOT.df(spark, folder), CHANGES.df(spark, folder), KEYS, _mark(spark, folder)
    )


@query("cdc_latest", with_ctes(CHANGES) + ", " + _LATEST.format(where="") + "SELECT user_id, pos, op, event_type, cents, props FROM latest")
def cdc_latest(spark: SparkSession, folder: str) -> DataFrame:
    return C.latest_per_key(CHANGES.df(spark, folder), KEYS)


@query(
    "snapshot_copy",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders",
)
def snapshot_copy(spark: SparkSession, folder: str) -> DataFrame:
    """Initial copy into generation 0 of a change table, read back."""
    table = ChangeTable(shared_dir(spark, "copy"), ("o_orderkey",))
    table.create(load(spark, folder, "orders"), 0)
    return table.state(spark).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def _land(spark: SparkSession, folder: str, path: str, where: str) -> None:
    CHANGES.df(spark, folder).filter(where).write.mode("append").parquet(path)


@query("cdc_apply_stream", _ALL_SQL)
def cdc_apply_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same apply as a stream over the event files, folded into a new generation."""
    raw = load(spark, folder, "events")
    table = ChangeTable(shared_dir(spark, "table"), tuple(KEYS))
    table.create(SNAPSHOT.df(spark, folder), -1)
    stream = read_landed(spark, folder, raw.schema, files="events.parquet").selectExpr(
        *[f"{e} AS {a}" for a, e in CHANGES.columns.items()]
    )
    table.start(stream, shared_dir(spark, "offsets")).awaitTermination()
    table.compact(spark)
    return table.state(spark)


@query("cdc_resume", _ALL_SQL)
def cdc_resume(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs over one checkpoint: the second takes up where the first stopped."""
    landing, offsets = shared_dir(spark, "landing"), shared_dir(spark, "offsets")
    table = ChangeTable(shared_dir(spark, "table"), tuple(KEYS))
    table.create(SNAPSHOT.df(spark, folder), -1)
    half = _half(spark, folder)
    schema = CHANGES.df(spark, folder).schema
    for where in (f"pos <= {half}", f"pos > {half}"):
        _land(spark, folder, landing, where)
        table.start(read_landed(spark, landing, schema), offsets).awaitTermination()
    return table.state(spark)


@query("cdc_replay", _ALL_SQL)
def cdc_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Changes delivered twice, the second time after newer ones were folded in."""
    landing, offsets = shared_dir(spark, "landing"), shared_dir(spark, "offsets")
    table = ChangeTable(shared_dir(spark, "table"), tuple(KEYS))
    table.create(SNAPSHOT.df(spark, folder), -1)
    half = _half(spark, folder)
    schema = CHANGES.df(spark, folder).schema
    for where in ("true", f"pos <= {half}"):
        _land(spark, folder, landing, where)
        table.start(read_landed(spark, landing, schema), offsets).awaitTermination()
        table.compact(spark)
    return table.state(spark)


@query("cdc_late_after_compact", _ALL_SQL)
def cdc_late_after_compact(spark: SparkSession, folder: str) -> DataFrame:
    """Every second position lands only after the others were folded into a generation."""
    landing, offsets = shared_dir(spark, "landing"), shared_dir(spark, "offsets")
    table = ChangeTable(shared_dir(spark, "table"), tuple(KEYS))
    table.create(SNAPSHOT.df(spark, folder), -1)
    schema = CHANGES.df(spark, folder).schema
    for where in ("pos % 2 = 1", "pos % 2 = 0"):
        _land(spark, folder, landing, where)
        table.start(read_landed(spark, landing, schema), offsets).awaitTermination()
        table.compact(spark)
    table.retire(spark)
    return table.state(spark)


@query("cdc_two_checkpoints", _ALL_SQL)
def cdc_two_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Two streams with checkpoints of their own feed one table."""
    table = ChangeTable(shared_dir(spark, "table"), tuple(KEYS))
    table.create(SNAPSHOT.df(spark, folder), -1)
    schema = CHANGES.df(spark, folder).schema
    for where in ("pos % 3 = 0", "pos % 3 > 0"):
        landing = shared_dir(spark, "landing")
        _land(spark, folder, landing, where)
        table.start(read_landed(spark, landing, schema), shared_dir(spark, "offsets")).awaitTermination()
    return table.state(spark)


@query("cdc_log_positions", _ALL_SQL)
def cdc_log_positions(spark: SparkSession, folder: str) -> DataFrame:
    """The same changes under binlog positions: numbered files, whose numbers outgrow their padding, and offsets."""
    table = ChangeTable(shared_dir(spark, "table"), tuple(KEYS))
    text = F.concat(F.lit("bin."), (F.col("pos") / 100).cast("bigint") + 999_990, F.lit(":"), (F.col("pos") % 100).cast("string"))
    changes = CHANGES.df(spark, folder).withColumn("pos", binlog_position(text))
    table.create(SNAPSHOT.df(spark, folder), binlog_position(F.lit("bin.000000:0")))
    for batch, where in enumerate(("user_id % 2 = 0", "user_id % 2 = 1")):
        table.write_batch(changes.filter(where), batch)
    table.compact(spark)
    return table.state(spark)


@query("cdc_stateful", _ALL_SQL)
def cdc_stateful(spark: SparkSession, folder: str) -> DataFrame:
    """The latest change per key held as streaming state: a late re-delivery cannot replace it."""
    landing, offsets = shared_dir(spark, "landing"), shared_dir(spark, "offsets")
    table = ChangeTable(shared_dir(spark, "table"), tuple(KEYS))
    table.create(SNAPSHOT.df(spark, folder), -1)
    half = _half(spark, folder)
    schema = CHANGES.df(spark, folder).schema
    for where in (f"pos > {half}", f"pos <= {half}"):
        _land(spark, folder, landing, where)
        state = latest_state(read_landed(spark, landing, schema), KEYS)
        table.start(state, offsets, "update").awaitTermination()
    return table.state(spark)


# Changes of two tables in one stream, with JSON images; some topics belong to nobody.
ENVELOPES = Derived(
    "envelopes",
    "events",
    {
        "pos": "event_id",
        "topic": "CASE WHEN value > 90 THEN 'other.shop.dead' WHEN event_type IN ('view', 'click') THEN 'dbz.shop.page_hits' "
        "ELSE 'dbz.shop.accounts' END",
        "op": "CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END",
        "before": "CASE WHEN event_type = 'error' THEN '{\"user_id\":' || user_id || '}' END",
        "after": "CASE WHEN event_type <> 'error' THEN '{\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}' END",
    },
)


@query(
    "cdc_routed_stream",
    with_ctes(ENVELOPES)
    + """, l AS (SELECT *, split_part(topic, '.', 3) AS t, CAST(json_extract(coalesce(after, before), '$.user_id') AS BIGINT) AS user_id FROM envelopes
      WHERE topic LIKE 'dbz.%'),
    k AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY t, user_id ORDER BY pos DESC) = 1)
    SELECT t AS "table", user_id, json_extract_string(after, '$.event_type') AS event_type FROM k WHERE op <> 'd'
    UNION ALL SELECT 'quarantine', count(*), NULL FROM envelopes WHERE topic NOT LIKE 'dbz.%'""",
)
def cdc_routed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """One stream fans out to two tables; unroutable changes are counted from quarantine."""
    landing = shared_dir(spark, "landing")
    envelopes = ENVELOPES.df(spark, folder)
    envelopes.write.json(landing)
    columns = T.StructType.fromDDL("user_id bigint, event_type string")
    tables = {name: ChangeTable(shared_dir(spark, name), ("user_id",)) for name in ("accounts", "page_hits")}
    for table in tables.values():
        table.create(spark.createDataFrame([], columns), -1)
    router = ChangeRouter(tables, dict.fromkeys(tables, columns), shared_dir(spark, "quarantine"), "dbz")
    stream = read_landed(spark, landing, envelopes.schema, fmt="json")
    router.start(stream, shared_dir(spark, "offsets")).awaitTermination()
    rejected = router.rejected(spark, envelopes.schema).agg(F.count("*").alias("user_id"))
    out = rejected.select(F.lit("quarantine").alias("table"), "user_id", F.lit(None).cast("string").alias("event_type"))
    for name, table in tables.items():
        out = out.unionByName(table.state(spark).select(F.lit(name).alias("table"), "user_id", "event_type"))
    return out


_ROUTES = """SELECT pos, topic, regexp_extract(topic, '^dbz\\.[^.]+\\.(.*)$', 1) AS r,
  regexp_extract(topic4, '^dbz\\.[^.]+\\.[^.]+\\.(.*)$', 1) AS table4 FROM topics"""


@query(
    "cdc_route",
    with_ctes(TOPICS)
    + f", t AS ({_ROUTES}) SELECT pos, nullif(r, '') AS \"table\", r IN ('users', 'views', 'clicks') AS routed, table4 FROM t",
)
def cdc_route(spark: SparkSession, folder: str) -> DataFrame:
    """Three- and four-part topics to tables, with an allow-list; unmatched topics stay visible."""
    routed = C.route(TOPICS.df(spark, folder), "dbz", include=["users", "views", "clicks"])
    four = C.route(
        routed.select("pos", F.col("table").alias("t3"), F.col("routed").alias("r3"), "topic4"),
        "dbz",
        segments=2,
        topic="topic4",
    )
    return four.select("pos", F.col("t3").alias("table"), F.col("r3").alias("routed"), F.col("table").alias("table4"))


# Whole-row changes of a table without a key, from the orders as ids.
_PCT = "CAST('0x' || substr(md5('{0}:' || o_orderkey), 1, 8) AS BIGINT) % 100"
CHURN_SQL = f"""churn AS (
  SELECT o_orderkey AS g, md5('actor:' || o_orderkey) AS actor, 'd-' || o_orderkey AS detail,
    {_PCT.format("churn-update")} < 30 AS edited, {_PCT.format("churn-delete")} < 20 AS gone FROM orders)"""


@query(
    "cdc_apply_multiset",
    f"""WITH {CHURN_SQL}, old AS (
      SELECT md5('actor:' || o_orderkey) AS actor,
        CASE o_orderkey % 3 WHEN 0 THEN 'login' WHEN 1 THEN 'delete' ELSE 'update' END AS action,
        CASE WHEN o_orderkey % 3 <> 0 THEN 'detail ' || o_orderkey END AS detail FROM orders)
    SELECT actor, action, detail, CAST(1 AS BIGINT) AS copies FROM old
    UNION ALL SELECT actor, CASE WHEN edited THEN 'edited' ELSE 'churn' END, detail, 1 FROM churn WHERE NOT gone""",
)
def cdc_apply_multiset(spark: SparkSession, folder: str) -> DataFrame:
    ids = load(spark, folder, "orders").select("o_orderkey")
    return C.apply_multiset(audit(ids, "o_orderkey"), churn(ids, "o_orderkey"))


@query(
    "cdc_multiset_rows",
    """WITH u AS (SELECT user_id, event_type, 1 AS n FROM events UNION ALL
      SELECT user_id, event_type, -1 FROM events WHERE props LIKE '%7}')
    SELECT user_id, event_type FROM (SELECT user_id, event_type, sum(n) AS c FROM u GROUP BY ALL), range(1000000) r(i)
    WHERE i < c""",
)
def cdc_multiset_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Deletes against heavily repeated rows, then back to single rows."""
    rows = load(spark, folder, "events").select("user_id", "event_type", "props")
    image = F.struct("user_id", "event_type")
    gone = rows.filter(F.col("props").endswith("7}")).select(
        F.lit("d").alias("op"), image.alias("before"), F.when(F.lit(False), image).alias("after")
    )
    return C.expand_copies(C.apply_multiset(rows.select("user_id", "event_type"), gone))


_TABLE = "CASE WHEN event_type IN ('view', 'click') THEN 'page_hits' ELSE 'accounts' END"
TABLES = Derived("tabled", "events", {"pos": "event_id", "table": _TABLE, "user_id": "user_id", "event_type": "event_type"})


@query(
    "cdc_new_table",
    with_ctes(TABLES)
    + """, m AS (SELECT max(event_id) // 4 AS a, max(event_id) // 2 AS p FROM events)
    SELECT "table", user_id, count(*) AS changes, max(pos) AS last_pos FROM tabled, m
    WHERE pos > CASE WHEN "table" = 'accounts' THEN a ELSE p END GROUP BY ALL""",
)
def cdc_new_table(spark: SparkSession, folder: str) -> DataFrame:
    """A table added later has its own snapshot position; each table counts from its own."""
    marks = {"accounts": _mark(spark, folder, 4), "page_hits": _mark(spark, folder, 2)}
    after = C.after_high_water(TABLES.df(spark, folder), marks)
    return after.groupBy("table", "user_id").agg(F.count("*").alias("changes"), F.max("pos").alias("last_pos"))


@query("cdc_high_waters", with_ctes(TABLES) + 'SELECT "table", max(pos) AS high_water FROM tabled GROUP BY ALL')
def cdc_high_waters(spark: SparkSession, folder: str) -> DataFrame:
    return C.high_waters(TABLES.df(spark, folder))


IMAGES = Derived(
    "images",
    "events",
    {
        "pos": "event_id",
        "after_json": "CASE WHEN event_type = 'purchase' THEN replace(props, '}', ', \"coupon\": 1}') "
        "WHEN event_type = 'click' THEN replace(props, '}', ', \"button\": 2}') ELSE props END",
    },
)


@query(
    "cdc_schema_drift",
    with_ctes(IMAGES)
    + """, f AS (SELECT pos, unnest(json_keys(after_json)) AS field FROM images),
    u AS (SELECT * FROM f WHERE field <> 'k')
    SELECT 'basic' AS policy, field, min(pos) AS first_pos, count(*) AS changes FROM u GROUP BY field
    UNION ALL SELECT 'none', 'accepted', min(pos), count(*) FROM images WHERE pos NOT IN (SELECT pos FROM u)
    UNION ALL SELECT 'none', 'quarantined', min(pos), count(*) FROM images WHERE pos IN (SELECT pos FROM u)""",
)
def cdc_schema_drift(spark: SparkSession, folder: str) -> DataFrame:
    """After-images with unknown fields: quarantined under ``none``, added under ``basic``."""
    images = IMAGES.df(spark, folder).withColumn("after", F.from_json("after_json", "map<string,string>"))
    accepted, quarantined = C.split_unknown_fields(images, "after", ["k"])

    def tally(df: DataFrame, label: str) -> DataFrame:
        return df.agg(F.min("pos").alias("first_pos"), F.count("*").alias("changes")).select(
            F.lit("none").alias("policy"), F.lit(label).alias("field"), "first_pos", "changes"
        )

    basic = C.added_fields(images, "after", ["k"]).select(F.lit("basic").alias("policy"), "field", "first_pos", "changes")
    return basic.unionByName(tally(accepted, "accepted")).unionByName(tally(quarantined, "quarantined"))
