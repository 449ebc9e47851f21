"""Queries on the edges of change apply: restarts, nulls, malformed images, schema history, chunked copies, positions, load order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.operators import changes as C
from twinproof.operators import conform as S
from twinproof.operators import reconcile as R
from twinproof.operators.history import SchemaHistory, Version, open_as_of
from twinproof.operators.loadorder import load_order as ordered_tables
from twinproof.plans.registry import Derived, query, with_ctes
from twinproof.plans.schema_plans import CASTS, RAW
from twinproof.plans.stream_plans import _ALL_SQL, _MERGED, CHANGES, ENVELOPES, KEYS, SNAPSHOT
from twinproof.session import shared_dir
from twinproof.sources.tables import TablePair, load
from twinproof.streaming.apply import ChangeRouter, ChangeTable, read_landed
from twinproof.streaming.keyed import newest_changes
from twinproof.streaming.snapshot import ChunkedSnapshot

# -- load order ----------------------------------------------------------------------------------

# Parts as tables that refer to parts with smaller numbers, but for two that refer to each other.
REFERENCES = Derived(
    "refs",
    "lineitem",
    {
        "child": "'t' || l_partkey",
        "parent": "'t' || CASE l_partkey WHEN 7 THEN 11 WHEN 11 THEN 7 ELSE l_partkey DIV (4 + l_linenumber % 2) END",
    },
)
LOADED = Derived("loaded", "part", {"table": "'t' || p_partkey"})


@query(
    "load_order",
    with_ctes(REFERENCES, LOADED).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, e AS (SELECT DISTINCT child, parent FROM refs WHERE child <> parent
      AND parent IN (SELECT "table" FROM loaded) AND child IN (SELECT "table" FROM loaded)),
    up AS (SELECT child AS a, parent AS b FROM e UNION SELECT up.a, e.parent FROM up JOIN e ON e.child = up.b),
    ring AS (SELECT a FROM up WHERE a = b),
    late AS (SELECT DISTINCT a FROM up WHERE b IN (SELECT a FROM ring)),
    depth AS (SELECT "table" AS t, 0 AS d FROM loaded WHERE "table" NOT IN (SELECT child FROM e)
      UNION SELECT e.child, d + 1 FROM depth JOIN e ON e.parent = depth.t WHERE e.child NOT IN (SELECT a FROM late)),
    levels AS (SELECT t, CAST(max(d) AS INTEGER) AS level FROM depth GROUP BY t)
    SELECT "table", level, CASE WHEN "table" IN (SELECT a FROM ring) THEN 'cycle' WHEN "table" IN (SELECT a FROM late) THEN 'behind a cycle'
      ELSE 'ordered' END AS state FROM loaded LEFT JOIN levels ON t = "table" """,
)
def load_order(spark: SparkSession, folder: str) -> DataFrame:
    """Levels in which tables can be loaded, parents first; one cycle of two tables and what hangs on it have none."""
    return ordered_tables(LOADED.df(spark, folder), REFERENCES.df(spark, folder))


# -- restarts, nulls, images ------------------------------------------------------------------------


@query("cdc_restarted_stream", _ALL_SQL)
def cdc_restarted_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A checkpoint is lost after a compaction, and a new one at the same path goes on with newer files."""
    table, offsets = ChangeTable(shared_dir(spark, "table"), tuple(KEYS)), shared_dir(spark, "offsets")
    table.create(SNAPSHOT.df(spark, folder), -1)
    changes = CHANGES.df(spark, folder)
    for where in ("pos % 2 = 0", "pos % 2 = 1"):
        landing = shared_dir(spark, "landing")
        changes.filter(where).write.parquet(landing)
        table.start(read_landed(spark, landing, changes.schema), offsets).awaitTermination()
        table.compact(spark)
        path = spark._jvm.org.apache.hadoop.fs.Path(offsets)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return table.state(spark)


# A key of two columns, one of which may be null.
PARTIAL = Derived(
    "partial",
    "events",
    {
        "pos": "event_id",
        "user_id": "user_id",
        "shard": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 END",
        "op": "CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END",
        "event_type": "event_type",
    },
)
PARTIAL_OLD = Derived(
    "old", "customer", {"user_id": "c_custkey", "shard": "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_custkey % 3 END", "event_type": "c_mktsegment"}
)


@query(
    "cdc_null_keys",
    with_ctes(PARTIAL, PARTIAL_OLD)
    + """, latest AS (SELECT * FROM partial QUALIFY row_number() OVER (PARTITION BY user_id, shard ORDER BY pos DESC) = 1)
    SELECT user_id, shard, event_type FROM old o WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.user_id = o.user_id AND l.shard IS NOT DISTINCT FROM o.shard)
    UNION ALL SELECT user_id, shard, event_type FROM latest WHERE op <> 'd'""",
)
def cdc_null_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys with a null part, applied in two batches with a compaction between."""
    table = ChangeTable(shared_dir(spark, "table"), ("user_id", "shard"))
    table.create(PARTIAL_OLD.df(spark, folder), -1)
    changes = PARTIAL.df(spark, folder)
    for i in (0, 1):
        table.write_batch(changes.filter(F.col("pos") % 2 == i), i)
        if i == 0:
            table.compact(spark)
    return table.state(spark).select("user_id", "shard", "event_type")


_BAD = """CASE WHEN event_id % 31 = 0 THEN 'malformed image' WHEN event_id % 37 = 0 THEN 'malformed image' WHEN event_id % 41 = 0 THEN 'null key'
  WHEN event_id % 43 = 0 THEN 'no image' WHEN event_id % 47 = 0 THEN 'unknown operation' END"""
_GOOD_AFTER = ENVELOPES.columns["after"]
BAD_ENVELOPES = ENVELOPES.but(
    "bad",
    after="""CASE WHEN event_id % 31 = 0 THEN '{"user_id":' WHEN event_id % 37 = 0 THEN '{"user_id":"x' || event_id || '"}' """
    """WHEN event_id % 41 = 0 THEN '{"user_id":null,"event_type":"view"}' WHEN event_id % 43 = 0 THEN NULL """
    """WHEN event_type <> 'error' THEN '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' END""",
    before="CASE WHEN event_id % 43 <> 0 AND event_type = 'error' THEN '{\"user_id\":' || user_id || '}' END",
    op="CASE WHEN event_id % 31 <> 0 AND event_id % 37 <> 0 AND event_id % 41 <> 0 AND event_id % 43 <> 0 AND event_id % 47 = 0 THEN 'x' "
    "WHEN event_type = 'signup' THEN 'c' WHEN event_type = 'error' THEN 'd' ELSE 'u' END",
    why=_BAD,
    user_id="user_id",
    kind="event_type",
)


@query(
    "cdc_bad_images",
    with_ctes(BAD_ENVELOPES)
    + """, r AS (SELECT *, CASE WHEN topic LIKE 'dbz.%' THEN split_part(topic, '.', 3) END AS t FROM bad),
    k AS (SELECT * FROM r WHERE t IS NOT NULL AND why IS NULL QUALIFY row_number() OVER (PARTITION BY t, user_id ORDER BY pos DESC) = 1)
    SELECT t AS "table", 'row' AS what, kind || ' ' || user_id AS value, CAST(1 AS BIGINT) AS n FROM k WHERE op <> 'd'
    UNION ALL SELECT t, 'rejected', CASE WHEN t IS NULL THEN 'unrouted' ELSE why END, count(*) FROM r WHERE t IS NULL OR why IS NOT NULL GROUP BY ALL""",
)
def cdc_bad_images(spark: SparkSession, folder: str) -> DataFrame:
    """Broken JSON, values of a wrong type, null keys, missing images and unknown operations go to quarantine, with their reasons."""
    landing, columns = shared_dir(spark, "landing"), T.StructType.fromDDL("user_id bigint, event_type string")
    changes = BAD_ENVELOPES.df(spark, folder).select("pos", "topic", "op", "before", "after")
    changes.write.parquet(landing)
    tables = {name: ChangeTable(shared_dir(spark, name), ("user_id",)) for name in ("accounts", "page_hits")}
    for table in tables.values():
        table.create(spark.createDataFrame([], columns), -1)
    router = ChangeRouter(tables, dict.fromkeys(tables, columns), shared_dir(spark, "quarantine"), "dbz")
    router.start(read_landed(spark, landing, changes.schema), shared_dir(spark, "offsets")).awaitTermination()
    rejected = router.rejected(spark, changes.schema, reasons=True).groupBy("source", "reason").agg(F.count("*").alias("n"))
    out = rejected.select(F.col("source").alias("table"), F.lit("rejected").alias("what"), F.col("reason").alias("value"), "n")
    for name, table in tables.items():
        value = F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))
        out = out.unionByName(table.state(spark).select(F.lit(name).alias("table"), F.lit("row").alias("what"), value.alias("value"), F.lit(1).cast("bigint").alias("n")))
    return out


# -- schema history ------------------------------------------------------------------------------------

_CENTS = "CAST(round(value * 100) AS BIGINT)"
_DAY = "DATE '1970-01-01' + CAST(event_id % 3000 AS INT)"
NOTED = Derived(
    "noted",
    "events",
    {
        "pos": "event_id",
        "op": "CASE event_type WHEN 'signup' THEN 'c' ELSE 'u' END",
        "early": f"'{{\"user_id\":' || user_id || ',\"amount\":' || {_CENTS} || ',\"day\":' || (event_id % 3000) || '}}'",
        "late": f"'{{\"user_id\":' || user_id || ',\"amount\":\"' || ({_CENTS} DIV 100) || '.' || lpad('' || ({_CENTS} % 100), 2, '0') || '\",\"day\":\"' "
        f"|| ({_DAY}) || '\",\"kind\":\"' || event_type || '\"}}'",
        "user_id": "user_id",
        "cents": _CENTS,
        "day": _DAY,
        "kind": "event_type",
    },
)


@query(
    "cdc_schema_history",
    with_ctes(NOTED)
    + """, m AS (SELECT max(event_id) // 2 AS note FROM events)
    SELECT pos, user_id, cents, CAST(day AS DATE) AS day, CASE WHEN pos >= note THEN kind END AS kind FROM noted, m""",
)
def cdc_schema_history(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts and days change their type in mid-stream and a column comes; each image is opened with the schema of its position."""
    history = SchemaHistory(shared_dir(spark, "schema-history"))
    note = load(spark, folder, "events").agg(F.max("event_id")).first()[0] // 2
    early = (("user_id", "bigint", None), ("amount", "bigint", "CAST({} AS DECIMAL(20,2)) / 100"), ("day", "int", "date_add(DATE'1970-01-01', {})"))
    late = (("user_id", "bigint", None), ("amount", "string", "try_cast({} AS DECIMAL(20,2))"), ("day", "date", None), ("kind", "string", None))
    history.record(spark, "accounts", Version(0, early))
    history.record(spark, "accounts", Version(note, late))
    raw = NOTED.df(spark, folder).select("pos", "op", F.when(F.col("pos") >= note, F.col("late")).otherwise(F.col("early")).alias("after"))
    target = T.StructType.fromDDL("user_id bigint, amount decimal(20,2), day date, kind string")
    opened = open_as_of(raw.withColumn("before", F.lit(None).cast("string")), history.versions(spark, "accounts"), target, ["user_id"])
    return opened.filter("_reason IS NULL").select("pos", "user_id", (F.col("amount") * 100).cast("bigint").alias("cents"), "day", "kind")


# -- copies and positions --------------------------------------------------------------------------------


@query("snapshot_chunks", _ALL_SQL)
def snapshot_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The initial copy in five chunks, out of order and one of them twice, while changes go on; then all changes on top."""
    rows, changes = SNAPSHOT.df(spark, folder), CHANGES.df(spark, folder)
    last = load(spark, folder, "events").agg(F.max("event_id")).first()[0]
    copy = ChunkedSnapshot(shared_dir(spark, "chunks"), "user_id")
    count = copy.plan(rows, 5)
    for step, chunk in enumerate([*range(count - 1, -1, -2), *range(count - 2, -1, -2), 0]):
        low, high = last * step // (count + 1), last * (step + 1) // (count + 1)
        # What a read between the two positions sees.
        seen = C.apply_changes(rows, changes.filter(F.col("pos") <= (low + high) // 2), KEYS)
        copy.read(seen, chunk, low, high)
    table = ChangeTable(shared_dir(spark, "table"), tuple(KEYS))
    copy.into(spark, table)
    table.write_batch(changes, 0)
    return table.state(spark)


_AT = "(SELECT max(event_id) // 2 FROM events)"
_STATE_AT = """{name} AS (WITH latest AS (SELECT * FROM changes WHERE pos <= {at} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) = 1) {merged})"""


@query(
    "reconcile_as_of",
    with_ctes(CHANGES, SNAPSHOT)
    + ", "
    + _STATE_AT.format(name="truth", at=_AT, merged=_MERGED)
    + ", "
    + _STATE_AT.format(name="latest_state", at="(SELECT max(event_id) FROM events)", merged=_MERGED)
    + """, d AS (SELECT CASE WHEN l.user_id IS NULL THEN 'missing_on_target' WHEN t.user_id IS NULL THEN 'extra_on_target' ELSE 'hash_diff' END AS kind
      FROM truth t FULL JOIN latest_state l ON l.user_id = t.user_id WHERE t.user_id IS NULL OR l.user_id IS NULL
        OR (t.event_type, t.cents, t.props) IS DISTINCT FROM (l.event_type, l.cents, l.props))
    SELECT 'latest' AS "table", kind, count(*) AS rows FROM d GROUP BY kind
    UNION ALL SELECT 'as_of', 'rows', count(*) FROM truth""",
)
def reconcile_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """A source compared with a change table that is already ahead: false alarms against its latest state, none as of the source's position."""
    rows, changes = SNAPSHOT.df(spark, folder), CHANGES.df(spark, folder)
    last = load(spark, folder, "events").agg(F.max("event_id")).first()[0]
    table = ChangeTable(shared_dir(spark, "table"), tuple(KEYS), history=True)
    table.create(rows, -1)
    cuts = [-1, last // 3, last * 3 // 4, last]
    for i, (above, upto) in enumerate(zip(cuts, cuts[1:])):
        table.write_batch(changes.filter(f"pos > {above} AND pos <= {upto}"), i)
        if i != 1:
            table.compact(spark)
    at = last // 2
    truth = C.apply_changes(rows, changes.filter(F.col("pos") <= at), KEYS)
    then = table.state(spark, as_of=at)
    found = [R.drill(TablePair(name, truth, df, KEYS)) for name, df in (("as_of", then), ("latest", table.state(spark)))]
    counts = found[0].unionByName(found[1]).groupBy("table", "kind").agg(F.count("*").alias("rows"))
    return counts.unionByName(then.agg(F.count("*").alias("rows")).select(F.lit("as_of").alias("table"), F.lit("rows").alias("kind"), "rows"))


@query("cdc_keyed_state", _ALL_SQL)
def cdc_keyed_state(spark: SparkSession, folder: str) -> DataFrame:
    """Re-delivered changes dropped by keyed state, across a restart from the same checkpoint; the table gets each key's newer changes only."""
    landing, offsets = shared_dir(spark, "landing"), shared_dir(spark, "offsets")
    table = ChangeTable(shared_dir(spark, "table"), tuple(KEYS))
    table.create(SNAPSHOT.df(spark, folder), -1)
    changes = CHANGES.df(spark, folder)
    for where in ("pos % 2 = 0", "true"):
        changes.filter(where).write.mode("append").parquet(landing)
        table.start(newest_changes(read_landed(spark, landing, changes.schema), KEYS), offsets).awaitTermination()
    return table.state(spark)


# -- rejected values --------------------------------------------------------------------------------------


@query(
    "conform_rejects",
    with_ctes(RAW)
    + """SELECT 'reject' AS part, l_orderkey, l_linenumber, 'small' AS "column", CAST(small AS VARCHAR) AS text, 'out of range' AS reason, CAST(NULL AS BIGINT) AS new_nulls
      FROM raw WHERE small > 32767
    UNION ALL SELECT 'reject', l_orderkey, l_linenumber, 'day', day, 'no such date', NULL FROM raw WHERE day = '0000-00-00'
    UNION ALL SELECT 'count', NULL, NULL, 'big', NULL, NULL, 0
    UNION ALL SELECT 'count', NULL, NULL, 'small', NULL, NULL, count(*) FILTER (WHERE small > 32767) FROM raw
    UNION ALL SELECT 'count', NULL, NULL, 'flag', NULL, NULL, count(*) FILTER (WHERE flag NOT IN (0, 1)) FROM raw
    UNION ALL SELECT 'count', NULL, NULL, 'day', NULL, NULL, count(*) FILTER (WHERE day = '0000-00-00') FROM raw
    UNION ALL SELECT 'count', NULL, NULL, c, NULL, NULL, 0 FROM (VALUES ('tags'), ('price'), ('at')) v(c)""",
)
def conform_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Values that do not fit their target type, as rows with their text and reason, and the counts taken in the same pass."""
    out = S.conform_split(RAW.df(spark, folder), CASTS, ["l_orderkey", "l_linenumber"])
    rejects = out.rejects.select(F.lit("reject").alias("part"), "l_orderkey", "l_linenumber", "column", "text", "reason")
    counts = out.counts.select(F.lit("count").alias("part"), "column", "new_nulls")
    return rejects.unionByName(counts, allowMissingColumns=True)
