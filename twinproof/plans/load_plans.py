"""Load generation driven by the keys of the given tables, and the fault matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.functions.scalars import lsn_position, tokens
from twinproof.operators import faults as X
from twinproof.operators import inventory as I
from twinproof.operators import loadgen as L
from twinproof.operators import reconcile as R
from twinproof.operators import rules as Q
from twinproof.operators.changes import apply_changes
from twinproof.operators.monitor import retained_watchdog
from twinproof.plans.fleet_plans import CATALOG_TABLES
from twinproof.plans.monitor_plans import SLOTS
from twinproof.plans.registry import query, with_ctes
from twinproof.plans.stream_plans import CHURN_SQL
from twinproof.session import shared_dir
from twinproof.sources.ledger import append_ledger, read_ledger
from twinproof.sources.tables import TablePair, load, mark_generated

_PCT = "(CAST('0x' || substr(md5('{0}:' || {1}), 1, 8) AS BIGINT) % 100)"


def _ids(spark: SparkSession, folder: str, table: str = "orders", key: str = "o_orderkey") -> DataFrame:
    return load(spark, folder, table).select(key)


@query(
    "load_seed",
    """SELECT o_orderkey AS id, 'seed ' || o_orderkey AS title, 'text' AS language, 'public' AS visibility,
      array_to_string([md5('seed:' || o_orderkey || ':' || i) FOR i IN range(1, 10)], ' ') AS content FROM orders""",
)
def load_seed(spark: SparkSession, folder: str) -> DataFrame:
    return L.seed_rows(_ids(spark, folder), "o_orderkey", 300)


@query("load_identity", "SELECT o_orderkey // 10 AS id, 'item ' || o_orderkey AS title FROM orders WHERE o_orderkey % 10 = 0")
def load_identity(spark: SparkSession, folder: str) -> DataFrame:
    """The identity-key table gets a tenth of the seed's rows."""
    return L.identity_rows(_ids(spark, folder), "o_orderkey")


@query(
    "load_adversarial",
    """SELECT c_custkey AS n, 'user' || c_custkey || '@example.com' AS email,
      CASE WHEN c_custkey % 7 <> 0 THEN 'Üsér ' || c_custkey || ' λ' END AS display_name,
      '{"plan":"' || CASE c_custkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'team' END || '","seq":' || c_custkey || '}' AS metadata,
      't' || (c_custkey % 5) || ' t' || (c_custkey % 11) AS tags,
      CAST(CAST(c_custkey * 1.23456789 AS DECIMAL(20,8)) AS VARCHAR) AS balance FROM customer""",
)
def load_adversarial(spark: SparkSession, folder: str) -> DataFrame:
    out = L.users(_ids(spark, folder, "customer", "c_custkey"), "c_custkey")
    return out.withColumns({"tags": F.array_join("tags", " "), "balance": F.col("balance").cast("string")})


@query(
    "load_adversarial_documents",
    f"""SELECT o_orderkey AS id, o_orderkey % 1000 + 1 AS owner, CASE WHEN o_orderkey % 9 <> 0 THEN 'title ' || o_orderkey END AS title,
      left(repeat(md5('doc:' || o_orderkey), 10), 300) || ' 日本語 ' || o_orderkey AS content, CAST(3 AS INTEGER) AS n_tokens,
      md5(CAST(o_orderkey AS VARCHAR)) AS blob,
      CASE o_orderkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'archived' WHEN 2 THEN 'flagged' ELSE 'deleted' END AS status,
      o_orderkey % 1000 AS views, CASE WHEN o_orderkey % 5 <> 0 THEN {_PCT.format("ratio", "o_orderkey")} / CAST(100 AS DOUBLE) END AS ratio,
      (o_orderkey % 48) || ' hours' AS ttl,
      '10.' || (o_orderkey % 256) || '.' || ((o_orderkey // 256) % 256) || '.' || (o_orderkey % 256) AS ip FROM orders""",
)
def load_adversarial_documents(spark: SparkSession, folder: str) -> DataFrame:
    out = L.documents(_ids(spark, folder), "o_orderkey", 1000)
    return out.withColumns({"n_tokens": F.size("search_vector"), "blob": F.lower(F.hex("blob"))}).drop("search_vector")


@query(
    "load_adversarial_events",
    """SELECT o_orderkey AS document_id, CAST(1 AS INTEGER) AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'view' ELSE 'edit' END AS kind,
      '{"g":' || o_orderkey || ',"ok":' || (o_orderkey % 2 = 0) || '}' AS data FROM orders""",
)
def load_adversarial_events(spark: SparkSession, folder: str) -> DataFrame:
    return L.document_events(_ids(spark, folder), "o_orderkey")


_CHANGES_SQL = f"""g AS (SELECT o_orderkey AS id, {_PCT.format("track", "o_orderkey")} < 70 AS tracked, md5('content:' || o_orderkey) AS content,
    {_PCT.format("update", "o_orderkey")} < 20 AS edited, {_PCT.format("delete", "o_orderkey")} < 15 AS gone FROM orders),
  c AS (SELECT id, tracked, content, id * 3 AS pos, 'c' AS op, CAST(NULL AS VARCHAR) AS title FROM g
    UNION ALL SELECT id, tracked, content, id * 3 + 1, 'u', 'edited' FROM g WHERE edited
    UNION ALL SELECT id, tracked, content, id * 3 + 2, 'd', NULL FROM g WHERE NOT tracked AND gone)"""


@query("load_changes", f"WITH {_CHANGES_SQL} SELECT * FROM c")
def load_changes(spark: SparkSession, folder: str) -> DataFrame:
    return L.mixed_changes(_ids(spark, folder), "o_orderkey")


@query("load_ledger_proof", f"WITH {_CHANGES_SQL} SELECT CAST(count(*) AS BIGINT) AS tracked, CAST(0 AS BIGINT) AS missing FROM g WHERE tracked")
def load_ledger_proof(spark: SparkSession, folder: str) -> DataFrame:
    """Apply the write load to an empty table: every tracked id in the ledger must have arrived."""
    changes = L.mixed_changes(_ids(spark, folder), "o_orderkey")
    path = shared_dir(spark, "ledger")
    append_ledger(changes.filter("tracked AND op = 'c'"), "id", path)
    empty = changes.filter(F.lit(False)).select("id", "content", "title")
    table = apply_changes(empty, changes, ["id"])
    ledger = read_ledger(spark, path)
    lost = R.ledger_missing(ledger, table, "id").agg(F.count("*")).scalar()
    return ledger.agg(F.count("*").alias("tracked")).withColumn("missing", lost)


@query(
    "load_churn",
    f"""WITH {CHURN_SQL}, c AS (SELECT g * 3 AS pos, 'c' AS op, NULL AS was, 'churn' AS becomes, detail FROM churn
      UNION ALL SELECT g * 3 + 1, 'u', 'churn', 'edited', detail FROM churn WHERE edited
      UNION ALL SELECT g * 3 + 2, 'd', CASE WHEN edited THEN 'edited' ELSE 'churn' END, NULL, detail FROM churn WHERE gone)
    SELECT * FROM c""",
)
def load_churn(spark: SparkSession, folder: str) -> DataFrame:
    return L.churn(_ids(spark, folder), "o_orderkey").select(
        "pos",
        "op",
        F.col("before.action").alias("was"),
        F.col("after.action").alias("becomes"),
        F.coalesce("after.detail", "before.detail").alias("detail"),
    )


# --- faults -----------------------------------------------------------------------------------

RATE = 97


def _hit():
    return F.col("o_orderkey") % RATE == 0


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "orders")


def _pair(source: DataFrame, target: DataFrame) -> TablePair:
    return TablePair("orders", source, target, ["o_orderkey"])


def _lost_pair(spark: SparkSession, folder: str) -> TablePair:
    df = _orders(spark, folder)
    return _pair(df, X.lose_rows(df, _hit()))


def _corrupt_pair(spark: SparkSession, folder: str) -> TablePair:
    df = _orders(spark, folder)
    return _pair(df, X.corrupt_rows(df, "o_orderpriority", _hit()))


def _derived_pair(spark: SparkSession, folder: str) -> TablePair:
    """Documents with a generated search column that differs on the target."""
    df = load(spark, folder, "documents").select("doc_id", "text", "lang")
    source = mark_generated(df.withColumn("search_vector", tokens(F.col("text"))), ["search_vector"])
    return TablePair("documents", source, X.drift_derived(source, "search_vector"), ["doc_id"])


@query("fault_lose_row", f"SELECT CAST(o_orderkey AS VARCHAR) AS pk, 'missing_on_target' AS kind FROM orders WHERE o_orderkey % {RATE} = 0")
def fault_lose_row(spark: SparkSession, folder: str) -> DataFrame:
    return R.drill(_lost_pair(spark, folder)).select("pk", "kind")


@query("fault_corrupt_row", f"SELECT CAST(o_orderkey AS VARCHAR) AS pk, 'hash_diff' AS kind FROM orders WHERE o_orderkey % {RATE} = 0")
def fault_corrupt_row(spark: SparkSession, folder: str) -> DataFrame:
    return R.drill(_corrupt_pair(spark, folder)).select("pk", "kind")


@query(
    "fault_derived",
    """WITH s AS (SELECT doc_id, text, lang, lower(text) AS derived FROM documents), t AS (SELECT doc_id, text, lang, reverse(derived) AS derived FROM s),
    d AS ((SELECT doc_id, text, lang FROM s EXCEPT ALL SELECT doc_id, text, lang FROM t) UNION ALL (SELECT doc_id, text, lang FROM t EXCEPT ALL SELECT doc_id, text, lang FROM s))
    SELECT 'documents' AS "table", (SELECT count(*) FROM s) AS source_rows, (SELECT count(*) FROM t) AS target_rows, (SELECT count(*) FROM d) = 0 AS match""",
)
def fault_derived(spark: SparkSession, folder: str) -> DataFrame:
    """Parity passes although the derived column differs everywhere."""
    return R.full_report(_derived_pair(spark, folder)).select("table", "source_rows", "target_rows", "match")


_STALLED_AT = 5_000_000


def _stalled(spark: SparkSession, folder: str) -> DataFrame:
    """Every consumer stops confirming at one position while the log keeps growing."""
    slots = SLOTS.df(spark, folder).withColumn("wal_status", F.lit("reserved"))
    now = lsn_position(F.col("current_lsn"))
    stalled = X.stall(slots.withColumn("confirmed", now), "confirmed", F.lit(_STALLED_AT).cast("decimal(20,0)"))
    return retained_watchdog(stalled.withColumn("retained_bytes", now - F.col("confirmed")))


@query(
    "fault_stall",
    with_ctes(SLOTS)
    + f"""SELECT sample, subscription, CASE WHEN (CAST('0x' || split_part(current_lsn, '/', 1) AS BIGINT) * 4294967296
      + CAST('0x' || split_part(current_lsn, '/', 2) AS BIGINT) - {_STALLED_AT}) / 1048576.0 > 2048 THEN 'abort' ELSE 'ok' END AS verdict FROM slots""",
)
def fault_stall(spark: SparkSession, folder: str) -> DataFrame:
    return _stalled(spark, folder).select("sample", "subscription", "verdict")


def _desynced(spark: SparkSession, folder: str) -> DataFrame:
    """Identities of one order table per customer, set behind their largest key."""
    orders = _orders(spark, folder)
    maxima = orders.groupBy(F.col("o_custkey").alias("table")).agg(F.max("o_orderkey").alias("max_value"))
    right = maxima.select(F.col("table").alias("sequence"), "table", (F.col("max_value") + 1).alias("next_value"))
    return I.identity_plan(maxima, X.desync(right, F.when(F.col("table") % 3 == 0, 1).otherwise(0)), right.select("sequence"))


@query(
    "fault_desync",
    """SELECT o_custkey AS sequence, max(o_orderkey) + 1 AS resync_to, o_custkey % 3 = 0 AS collides FROM orders GROUP BY o_custkey""",
)
def fault_desync(spark: SparkSession, folder: str) -> DataFrame:
    return _desynced(spark, folder).select("sequence", "resync_to", "collides")


def _identity(spark: SparkSession, folder: str) -> DataFrame:
    broken = X.drop_identity(CATALOG_TABLES.df(spark, folder), F.col("relkind") == "p")
    return broken.withColumn("ok", Q.replica_identity_ok(F.col("identity"), F.col("has_key")))


@query(
    "fault_identity",
    with_ctes(CATALOG_TABLES)
    + """SELECT "table", relkind <> 'p' AND ((identity = 'd' AND has_key) OR identity IN ('f', 'i')) AS ok FROM catalog_tables""",
)
def fault_identity(spark: SparkSession, folder: str) -> DataFrame:
    return _identity(spark, folder).select("table", "ok")


@query(
    "fault_matrix",
    with_ctes(SLOTS, CATALOG_TABLES)
    + f""", lost AS (SELECT * FROM orders WHERE o_orderkey % {RATE} <> 0),
    corrupt AS (SELECT * REPLACE (CASE WHEN o_orderkey % {RATE} = 0 THEN o_orderpriority || '_corrupted' ELSE o_orderpriority END AS o_orderpriority) FROM orders),
    docs AS (SELECT doc_id, text, lang FROM (SELECT *, reverse(lower(text)) AS derived FROM documents)),
    stalled AS (SELECT CAST('0x' || split_part(current_lsn, '/', 1) AS BIGINT) * 4294967296 + CAST('0x' || split_part(current_lsn, '/', 2) AS BIGINT) AS now FROM slots),
    behind AS (SELECT max(o_orderkey) AS used, max(o_orderkey) + 1 - CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS next_value FROM orders GROUP BY o_custkey),
    o(fault, expected, observed) AS (
      SELECT 'none', false, EXISTS (FROM orders EXCEPT ALL FROM orders)
      UNION ALL SELECT 'lose-row', true, EXISTS (FROM orders EXCEPT ALL FROM lost) OR EXISTS (FROM lost EXCEPT ALL FROM orders)
      UNION ALL SELECT 'corrupt-row', true, EXISTS (FROM orders EXCEPT ALL FROM corrupt) OR EXISTS (FROM corrupt EXCEPT ALL FROM orders)
      UNION ALL SELECT 'derived-drift', false, EXISTS (SELECT doc_id, text, lang FROM documents EXCEPT ALL FROM docs)
      UNION ALL SELECT 'stall', true, (SELECT bool_or((now - least(now, {_STALLED_AT})) / 1048576.0 > 2048) FROM stalled)
      UNION ALL SELECT 'desync', true, (SELECT bool_or(next_value <= used) FROM behind)
      UNION ALL SELECT 'drop-identity', true, (SELECT bool_or(NOT coalesce(relkind <> 'p' AND ((identity = 'd' AND has_key) OR identity IN ('f', 'i')), false)) FROM catalog_tables))
    SELECT fault, expected, observed, observed = expected AS caught FROM o""",
)
def fault_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Inject each fault into the whole table and run the check that must notice it."""
    orders = _orders(spark, folder)

    def parity(pair: TablePair) -> DataFrame:
        return R.full_report(pair).select((~F.col("match")).alias("fails"))

    return X.fault_matrix(
        [
            ("none", False, parity(_pair(orders, orders))),
            ("lose-row", True, parity(_lost_pair(spark, folder))),
            ("corrupt-row", True, parity(_corrupt_pair(spark, folder))),
            ("derived-drift", False, parity(_derived_pair(spark, folder))),
            ("stall", True, _stalled(spark, folder).agg(F.bool_or(F.col("verdict") == "abort").alias("fails"))),
            ("desync", True, _desynced(spark, folder).agg(F.bool_or("collides").alias("fails"))),
            ("drop-identity", True, _identity(spark, folder).agg(F.bool_or(~F.col("ok")).alias("fails"))),
        ]
    )
