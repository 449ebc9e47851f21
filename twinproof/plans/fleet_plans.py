"""Inventory, readiness and settings queries over a fleet derived from the given tables.

One customer stands for a server, one part for a catalog column or an installed item, one
order for a published table, so every input grows with its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.functions import scalars as S
from twinproof.operators import inventory as I
from twinproof.operators import rules as Q
from twinproof.operators import settings as C
from twinproof.sources.reports import ordered
from twinproof.plans.registry import Derived, pick, query, with_ctes
from twinproof.sources.tables import load

# --- settings -------------------------------------------------------------------------------

SETTINGS = Derived(
    "settings",
    "customer",
    {
        "server": "c_custkey",
        "role_id": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 97 END",
        "database_id": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END",
        "kvs": "'work_mem=' || (c_custkey % 64) || 'MB;search_path=a=b;noequalsign;=odd;max_wal_size=' || c_mktsegment",
    },
)
SETTINGS_T = SETTINGS.but(
    "settings_t",
    kvs="CASE WHEN c_custkey % 13 = 0 THEN 'only_here=1;search_path=a=b' WHEN c_custkey % 7 = 0 THEN "
    "'work_mem=1GB;search_path=a=b;=odd;max_wal_size=' || c_mktsegment ELSE 'work_mem=' || (c_custkey % 64) || "
    "'MB;search_path=a=c;=odd;max_wal_size=' || c_mktsegment END",
)
_PARSE = """{0}_p AS (SELECT server, coalesce(s_name, '*') || '@' || coalesce(n_name, '*') AS scope,
    split_part(kv, '=', 1) AS key, substr(kv, strpos(kv, '=') + 1) AS value
  FROM (SELECT *, unnest(string_split(kvs, ';')) AS kv FROM {0}) x
    LEFT JOIN supplier ON role_id = s_suppkey LEFT JOIN nation ON database_id = n_nationkey
  WHERE strpos(kv, '=') > 0)"""
_TUNED = ", ".join(f"'{k}'" for k in I.SIZE_TUNED)


def _parsed(spark: SparkSession, folder: str, which: Derived) -> DataFrame:
    roles = load(spark, folder, "supplier").select(F.col("s_suppkey").alias("role_id"), F.col("s_name").alias("rolname"))
    databases = load(spark, folder, "nation").select(
        F.col("n_nationkey").alias("database_id"), F.col("n_name").alias("datname")
    )
    rows = which.df(spark, folder).withColumn("setconfig", F.split("kvs", ";"))
    return I.parse_settings(rows, roles, databases)


@query(
    "settings_diff",
    with_ctes(SETTINGS, SETTINGS_T)
    + f""", {_PARSE.format("settings")}, {_PARSE.format("settings_t")}
    SELECT s.server, s.scope, s.key, s.value AS source_value, t.value AS target_value,
      CASE WHEN t.key IS NULL THEN 'source_only' ELSE 'changed' END AS kind, s.key IN ({_TUNED}) AS size_tuned
    FROM settings_p s LEFT JOIN settings_t_p t ON s.server = t.server AND s.scope = t.scope AND s.key = t.key
    WHERE t.key IS NULL OR t.value <> s.value""",
)
def settings_diff(spark: SparkSession, folder: str) -> DataFrame:
    return I.settings_diff(_parsed(spark, folder, SETTINGS), _parsed(spark, folder, SETTINGS_T))


PAYLOADS = Derived(
    "payloads",
    "customer",
    {
        "server": "c_custkey",
        "kvs": "'smtp_pass:' || c_name || ';site_url:https://' || c_mktsegment || ';hook_send_sms_secrets:x;hook_send_sms_uri:u"
        ";hook_custom_headers:h;jwt_secret:j;passkey_id:p;sms_twilio_sid:s;sessions_single_per_user:true;rate_limit_sms_sent:30;"
        "api_jwt-secret:k;features:f'",
    },
)
_SECRET_SQL = (
    "(key IN (" + ", ".join(f"'{k}'" for k in S.SECRET_NAMES) + ") OR regexp_matches(key, '" + "|".join(S.SECRET_PATTERNS) + "'))"
)


@query(
    "redact_settings",
    with_ctes(PAYLOADS)
    + f""", e AS (SELECT server, split_part(kv, ':', 1) AS key, nullif(substr(kv, strpos(kv, ':') + 1), 'h') AS value
      FROM (SELECT server, unnest(string_split(kvs, ';')) AS kv FROM payloads))
    SELECT server, key, CASE WHEN {_SECRET_SQL} OR regexp_matches(key, 'jwt[_-]?secret', 'i') THEN '****' ELSE value END AS shown,
      NOT {_SECRET_SQL} AS copied, value IS NOT NULL AND key <> 'jwt_secret' AS api_kept,
      key NOT IN ('capabilities', 'migrationVersion', 'databasePoolMode', 'features') AS storage_kept FROM e""",
)
def redact_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Each setting as displayed, and whether the auth, API and storage copies keep it."""
    m = F.transform_values(F.str_to_map("kvs", F.lit(";"), F.lit(":")), lambda k, v: v)
    m = F.transform_values(m, lambda k, v: F.when(v != "h", v))
    df = PAYLOADS.df(spark, folder).select(
        "server",
        F.map_entries(C.redact(m)).alias("shown"),
        F.map_keys(C.strip_secrets(m)).alias("auth"),
        F.map_keys(C.api_settings(m)).alias("api"),
        F.map_keys(C.strip_keys(m, C.STORAGE_KEYS)).alias("storage"),
    )
    return df.select("*", F.explode("shown").alias("e")).select(
        "server",
        F.col("e.key").alias("key"),
        F.col("e.value").alias("shown"),
        F.array_contains("auth", F.col("e.key")).alias("copied"),
        F.array_contains("api", F.col("e.key")).alias("api_kept"),
        F.array_contains("storage", F.col("e.key")).alias("storage_kept"),
    )


BODIES = Derived(
    "bodies",
    "customer",
    {
        "server": "c_custkey",
        "body": """CASE WHEN c_custkey % 6 = 0 THEN '{"config":{"dbAllowedCidrs":["10.0.0.' || (c_custkey % 256) || '/32","1.1.1.1/32"]}}' """
        """WHEN c_custkey % 6 = 1 THEN '{"currentConfig":{"database":true},"config":{"dbAllowedCidrsV6":["::/0"]}}' """
        """WHEN c_custkey % 6 = 2 THEN '{"currentConfig":{},"secrets":[{"name":"K' || c_custkey || '","value":"v"},{"name":"x"},{"value":"y"}]}' """
        "ELSE '{}' END",
    },
)


@query(
    "reshape_settings",
    with_ctes(BODIES)
    + """SELECT server, array_to_string(CAST(json_extract(body, '$.config.dbAllowedCidrs') AS VARCHAR[]), ' ') AS cidrs,
      array_to_string(CAST(json_extract(body, '$.config.dbAllowedCidrsV6') AS VARCHAR[]), ' ') AS cidrs_v6,
      coalesce(CAST(json_extract(body, '$.currentConfig.database') AS BOOLEAN), false) AS database_ssl,
      CASE WHEN server % 6 = 2 THEN 'K' || server || '=v' END AS secrets FROM bodies""",
)
def reshape_settings(spark: SparkSession, folder: str) -> DataFrame:
    out = C.reshape(BODIES.df(spark, folder))
    pairs = F.array_join(F.transform("secrets", lambda s: F.concat(s["name"], F.lit("="), s["value"])), " ")
    return out.select(
        "server",
        F.array_join("cidrs", " ").alias("cidrs"),
        F.array_join("cidrs_v6", " ").alias("cidrs_v6"),
        "database_ssl",
        F.nullif(pairs, F.lit("")).alias("secrets"),
    )


LOGS = Derived(
    "logs",
    "events",
    {
        "event_id": "event_id",
        "line": "CASE event_type WHEN 'error' THEN 'dump postgres://app:pw' || event_id || '@db' || user_id || '.example.com:5432/x to file' "
        "WHEN 'view' THEN 'POSTGRESQL://u' || user_id || ':s3cret@h/x and postgres://a:b@c/d' "
        "WHEN 'click' THEN 'postgres://nopassword@h/x' ELSE 'https://user:kept@h/' || event_id END",
    },
)


@query(
    "mask_url_secrets",
    with_ctes(LOGS)
    + r"""SELECT event_id, regexp_replace(line, '\b(postgres(?:ql)?://[^:/@\s]*):([^@/\s]+)@', '\1:***@', 'gi') AS line FROM logs""",
)
def mask_url_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return C.mask_log(LOGS.df(spark, folder))


_HOSTS = [
    "db.abc{0}.supabase.co:5432",
    "aws-0-eu.pooler.supabase.com:6543",
    "aws-0-eu.pooler.supabase.com",
    "x{0}.cluster-ro-c1.eu-west-1.rds.amazonaws.com:5432",
    "x{0}.c1.eu-west-1.rds.amazonaws.com:5433",
    "ep-{0}.eu.neon.tech",
    "a{0}.horizon.psdb.cloud:3306",
    "srv{0}.postgres.database.azure.com",
    "DB{0}.Example.org:15432",
]
_REFS = ["abc{0}"] + [None] * 8
_PROVIDERS = [
    "supabase", "supabase", "supabase", "aurora-postgres", "rds-postgres", "neon", "planetscale-postgres", "azure-postgres", "generic",
]
_PORTS = [5432, 6543, 5432, 5432, 5433, 5432, 3306, 5432, 15432]
_KIND9 = "c_custkey % 9"
ENDPOINTS = Derived(
    "endpoints",
    "customer",
    {
        "server": "c_custkey",
        "url": "'postgresql://u%40x:p@' || replace(" + pick(_KIND9, _HOSTS) + ", '{0}', CAST(c_custkey AS STRING)) || '/app%20' || c_nationkey || '?sslmode=require'",
    },
)


@query(
    "classify_endpoints",
    f"""SELECT c_custkey AS server, {pick(_KIND9, _PROVIDERS)} AS provider,
      CAST({pick(_KIND9, [str(p) for p in _PORTS])} AS INTEGER) AS port, {_KIND9} IN (1, 2) AS is_pooler,
      {_KIND9} = 1 AS is_transaction_pooler, {_KIND9} = 0 AS is_direct,
      CASE WHEN {_KIND9} = 0 THEN 'abc' || c_custkey END AS ref, {_KIND9} NOT IN (1, 2) AS can_replicate,
      {_KIND9} IN (0, 1, 2) AS is_hosted, 'u@x' AS "user", 'app ' || c_nationkey AS "database" FROM customer""",
)
def classify_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    return C.classify_endpoints(ENDPOINTS.df(spark, folder)).drop("url", "host")


ERRORS = Derived(
    "errors",
    "events",
    {
        "event_id": "event_id",
        "event_type": "event_type",
        "message": pick(
            "event_id + user_id",
            [
                "read ECONNRESET", "EPIPE", "connect ETIMEDOUT", "ENETUNREACH", "EHOSTUNREACH", "Connection unexpectedly closed", "connection ended", "connection terminated",
                "connection reset", "connection timeout", "write CONNECTION lost", "read CONNECTION lost", "CONNECT_TIMEOUT host", "CONNECTION_CLOSED", "CONNECTION_ENDED",
                "CONNECTION_DESTROYED", "CONNECTION_CONNECT_TIMEOUT", "duplicate key", "connection is fine", "CONNECTION_REFUSED", None,
            ],
        ),
        "state": pick("event_id DIV 3", ["23505", "08006", "57P01", "57P04", "0800", None]),
    },
)


@query(
    "transient_errors",
    with_ctes(ERRORS)
    + r"""SELECT event_type, message, state, coalesce(regexp_matches(message,
      'econnreset|epipe|etimedout|enetunreach|ehostunreach|connection.*(clos|end|terminat|reset|timeout)|write connection|read connection|connect_timeout|connection_(closed|ended|destroyed|connect_timeout)', 'i'), false)
      OR coalesce(regexp_matches(state, '^(08\d\d\d|57P0[123])$'), false) AS transient, count(*) AS errors FROM errors GROUP BY ALL""",
)
def transient_errors(spark: SparkSession, folder: str) -> DataFrame:
    df = ERRORS.df(spark, folder).withColumn("transient", S.is_transient(F.col("message"), F.col("state")))
    return df.groupBy("event_type", "message", "state", "transient").agg(F.count("*").alias("errors"))


ENV = Derived(
    "env",
    "events",
    {
        "file": "user_id",
        "ordinal": "event_id",
        "line": "CASE event_type WHEN 'view' THEN '  export DB_' || (event_id % 3) || ' = \"v=' || event_id || '\"  ' "
        "WHEN 'click' THEN '# KEY=comment' WHEN 'signup' THEN '9bad=' || event_id WHEN 'error' THEN 'NAME=''q' || event_id || '''' "
        "ELSE 'PLAIN=' || props END",
    },
)


@query(
    "parse_kv_lines",
    with_ctes(ENV)
    + """, k AS (SELECT file, ordinal, CASE WHEN line LIKE '%export%' THEN trim(split_part(replace(trim(line), 'export ', ''), '=', 1))
        ELSE split_part(line, '=', 1) END AS key,
      trim(trim(substr(line, strpos(line, '=') + 1)), '"''') AS value FROM env WHERE line NOT LIKE '#%' AND line NOT LIKE '9bad%')
    SELECT file, key, value FROM k QUALIFY row_number() OVER (PARTITION BY file, key ORDER BY ordinal DESC) = 1""",
)
def parse_kv_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Env files line by line; the last assignment of a key wins."""
    parsed = C.parse_env(ENV.df(spark, folder))
    return parsed.groupBy("file", "key").agg(F.max_by("value", "ordinal").alias("value"))


# --- keyed inventories ------------------------------------------------------------------------

ITEMS = Derived(
    "items",
    "part",
    {
        "server": "p_partkey DIV 8",
        "item": pick("p_partkey", ["plpgsql", "pg_net", "pg_cron", "wrappers", "pg_repack", "citext", "vector", "postgis"]),
        "version": "'0.' || p_size",
    },
)
ITEMS_T = ITEMS.but(
    "items_t", where="p_size <> 11", version="CASE WHEN p_partkey % 5 = 0 THEN '1.' || p_size ELSE '0.' || p_size END"
)


@query(
    "missing_items",
    with_ctes(ITEMS, ITEMS_T)
    + """SELECT server, item FROM items s WHERE item <> 'plpgsql'
      AND NOT EXISTS (SELECT 1 FROM items_t t WHERE t.server = s.server AND t.item = s.item)""",
)
def missing_items(spark: SparkSession, folder: str) -> DataFrame:
    return ordered(I.missing_items(ITEMS.df(spark, folder), ITEMS_T.df(spark, folder), ["server", "item"], "item"), "server")


_RISK = "CASE item " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in I.UPGRADE_RISK.items()) + " END"


@query(
    "version_mismatch",
    with_ctes(ITEMS, ITEMS_T)
    + f"""SELECT s.server, s.item, s.version AS source_version, t.version AS target_version, {_RISK.replace("CASE item", "CASE s.item")} AS risk
      FROM items s JOIN items_t t ON s.server = t.server AND s.item = t.item WHERE s.version <> t.version""",
)
def version_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    return ordered(I.version_mismatch(ITEMS.df(spark, folder), ITEMS_T.df(spark, folder), ["server", "item"], "item"), "server")


ENTRIES = Derived(
    "entries",
    "customer",
    {
        "server": "c_nationkey",
        "id": "c_custkey",
        "issuer": "CASE WHEN c_custkey % 3 = 0 THEN 'https://issuer/' || (c_custkey DIV 2) END",
        "jwks": "CASE WHEN c_custkey % 3 < 2 THEN 'https://jwks/' || (c_custkey DIV 2) END",
        "metadata_url": "CASE WHEN c_custkey % 4 = 0 THEN 'https://meta/' || c_custkey WHEN c_custkey % 4 = 1 THEN '' END",
        "metadata_xml": "CASE WHEN c_custkey % 4 < 3 THEN '<x' || c_custkey || '/>' END",
        "domain_list": "CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_custkey || '.org,,b.org' ELSE '' END",
    },
)
ENTRIES_T = ENTRIES.but("entries_t", where="c_mktsegment <> 'BUILDING'")


@query(
    "additive_plan",
    with_ctes(ENTRIES, ENTRIES_T)
    + """, s AS (SELECT *, coalesce(issuer, jwks) AS k FROM entries)
    SELECT server, id, k AS entry_key, nullif(metadata_url, '') AS body_url,
      CASE WHEN coalesce(metadata_url, '') = '' THEN metadata_xml END AS body_xml,
      CASE WHEN domain_list <> '' THEN replace(domain_list, ',,', ' ') END AS body_domains
    FROM s WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM entries_t t WHERE t.server = s.server AND coalesce(t.issuer, t.jwks) = s.k)""",
)
def additive_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Integrations to add: keyed by issuer, else by key-set URL; bodies prefer a URL."""
    key = F.coalesce("issuer", "jwks")
    plan = I.additive_plan(ENTRIES.df(spark, folder), ENTRIES_T.df(spark, folder), "server", key)
    bodies = I.provider_body(plan.withColumn("domains", F.split("domain_list", ",")))
    return bodies.select(
        "server", "id", F.col("_key").alias("entry_key"), "body_url", "body_xml", F.array_join("body_domains", " ").alias("body_domains")
    )


_ADDONS = ["compute_instance", "pitr", "ipv4", "custom_domain"]
ADDONS = Derived(
    "addons",
    "customer",
    {
        "project": "c_custkey DIV 4",
        "addon": pick("c_custkey", _ADDONS),
        "variant": "CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE 'v' || (c_nationkey % 3) END",
        "amount": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END",
        "interval": "CASE WHEN c_custkey % 2 = 0 THEN 'monthly' END",
    },
)
ADDONS_T = ADDONS.but("addons_t", where="c_mktsegment <> 'MACHINERY'", variant="'v' || (c_custkey % 3)")


@query(
    "upgrade_plan",
    with_ctes(ADDONS, ADDONS_T)
    + """SELECT s.project, s.addon, s.variant AS to_variant, t.variant AS from_variant,
      CASE WHEN s.amount IS NULL THEN 'price n/a' ELSE '$' || s.amount || '/' || coalesce(s.interval, '?') END AS price
    FROM addons s LEFT JOIN addons_t t ON s.project = t.project AND s.addon = t.addon
    WHERE s.addon <> 'custom_domain' AND s.variant IS NOT NULL AND s.variant IS DISTINCT FROM t.variant""",
)
def upgrade_plan(spark: SparkSession, folder: str) -> DataFrame:
    return I.upgrade_plan(ADDONS.df(spark, folder), ADDONS_T.df(spark, folder), "project", _ADDONS[:3])


DISKS = Derived(
    "disks",
    "customer",
    {
        "server": "c_custkey",
        "size_gb": "c_nationkey * 8",
        "iops": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 3000 END",
        "type": "c_mktsegment",
    },
)
DISKS_T = DISKS.but("disks_t", size_gb="CASE WHEN c_custkey % 4 = 0 THEN 8 ELSE c_nationkey * 8 END", iops="3000")


@query(
    "attribute_changes",
    with_ctes(DISKS, DISKS_T)
    + """SELECT s.server, concat_ws(',', CASE WHEN s.size_gb IS DISTINCT FROM t.size_gb THEN 'size_gb' END,
      CASE WHEN s.iops IS DISTINCT FROM t.iops THEN 'iops' END) AS changed,
      s.size_gb IS DISTINCT FROM t.size_gb OR s.iops IS DISTINCT FROM t.iops AS change FROM disks s JOIN disks_t t USING (server)""",
)
def attribute_changes(spark: SparkSession, folder: str) -> DataFrame:
    out = I.attribute_changes(DISKS.df(spark, folder), DISKS_T.df(spark, folder), "server", ["size_gb", "iops", "type"])
    return out.select("server", F.array_join("changed_attributes", ",").alias("changed"), "change")


EDGES = Derived(
    "edges",
    "lineitem",
    {
        "table": "'public.o' || l_orderkey",
        "references": "CASE WHEN l_linenumber < 3 THEN 'auth.s' || l_suppkey WHEN l_linenumber < 6 THEN 'public.o' || l_partkey "
        "ELSE 'stock.p' || l_partkey END",
    },
)
REPLICATED = Derived("replicated", "orders", {"table": "'public.o' || o_orderkey"}, where="o_orderstatus <> 'P'")


@query(
    "external_deps",
    with_ctes(EDGES, REPLICATED)
    + """SELECT DISTINCT "references", split_part("references", '.', 1) AS schema FROM edges
    WHERE "table" IN (SELECT "table" FROM replicated) AND "references" NOT IN (SELECT "table" FROM replicated)""",
)
def external_deps(spark: SparkSession, folder: str) -> DataFrame:
    return ordered(I.external_deps(EDGES.df(spark, folder), REPLICATED.df(spark, folder)))


@query(
    "external_schemas",
    with_ctes(EDGES, REPLICATED)
    + """SELECT DISTINCT split_part("references", '.', 1) AS schema FROM edges
    WHERE "table" IN (SELECT "table" FROM replicated) AND "references" NOT IN (SELECT "table" FROM replicated)""",
)
def external_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """Schemas to load before the initial copy."""
    return ordered(external_deps(spark, folder).select("schema").distinct())


PUBLISHED = Derived("published", "orders", {"server": "o_custkey", "table": "'public.o' || o_orderkey"})
SUBSCRIBED = PUBLISHED.but("subscribed", where="o_orderstatus <> 'F'")


@query("unsubscribed_tables", with_ctes(PUBLISHED, SUBSCRIBED) + "SELECT * FROM published EXCEPT SELECT * FROM subscribed")
def unsubscribed_tables(spark: SparkSession, folder: str) -> DataFrame:
    return I.unsubscribed(PUBLISHED.df(spark, folder), SUBSCRIBED.df(spark, folder), ["server", "table"])


CONSUMERS = Derived(
    "consumers",
    "customer",
    {
        "server": "c_nationkey",
        "slot_name": "CASE WHEN c_mktsegment = 'BUILDING' THEN 'mover' ELSE lower(c_mktsegment) || c_custkey END",
        "slot_type": "CASE WHEN c_acctbal < 0 THEN 'physical' ELSE 'logical' END",
        "plugin": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'pgoutput' END",
        "active": "c_custkey % 3 = 0",
    },
)


@query(
    "foreign_consumers",
    with_ctes(CONSUMERS) + "SELECT * FROM consumers WHERE slot_type = 'logical' AND slot_name <> 'mover'",
)
def foreign_consumers(spark: SparkSession, folder: str) -> DataFrame:
    return ordered(I.foreign_consumers(CONSUMERS.df(spark, folder), F.lit("mover")))


_ID_TABLES = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id"}


@query(
    "identity_resync",
    "WITH m AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", max({k}) AS max_value FROM {t}" for t, k in _ID_TABLES.items())
    + " UNION ALL SELECT 'empty', max(o_orderkey) FROM orders WHERE o_orderkey < 0), i AS ("
    + " UNION ALL ".join(f"SELECT '{t}_seq' AS sequence, '{t}' AS \"table\", count(*) // 2 + {5 if t == 'part' else 0} AS next_value FROM {t}" for t in _ID_TABLES)
    + """ UNION ALL SELECT 'empty_seq', 'empty', 1), n AS (SELECT sequence FROM i UNION SELECT 'manual_seq')
    SELECT n.sequence, i."table", next_value, max_value, max_value + 1 AS resync_to, coalesce(next_value <= max_value, false) AS collides
    FROM n LEFT JOIN i USING (sequence) LEFT JOIN m ON i."table" = m."table" """,
)
def identity_resync(spark: SparkSession, folder: str) -> DataFrame:
    """Next identity values after the largest keys; an empty table and a manual sequence included."""
    maxima, identities = None, None
    for table, key in {**_ID_TABLES, "empty": "o_orderkey"}.items():
        df = load(spark, folder, "orders" if table == "empty" else table).select(key)
        if table == "empty":
            df = df.filter(F.col(key) < 0)
        m = df.agg(F.max(key).alias("max_value")).select(F.lit(table).alias("table"), "max_value")
        start = F.lit(1).cast("bigint") if table == "empty" else F.floor(F.count("*") / 2) + (5 if table == "part" else 0)
        i = df.agg(start.alias("next_value")).select(
            F.lit(f"{table}_seq").alias("sequence"), F.lit(table).alias("table"), "next_value"
        )
        maxima = m if maxima is None else maxima.unionByName(m)
        identities = i if identities is None else identities.unionByName(i)
    manual = maxima.filter(F.col("table") == "empty").select(F.lit("manual_seq").alias("sequence"))
    return I.identity_plan(maxima, identities, manual).select(
        "sequence", "table", "next_value", "max_value", "resync_to", "collides"
    )


FLEET = Derived(
    "fleet",
    "customer",
    {
        "server": "c_custkey",
        "max_replication_slots": "c_nationkey % 6",
        "used_slots": "c_custkey % 4",
        "max_wal_senders": "c_nationkey % 5",
        "used_senders": "c_custkey % 5",
        "max_worker_processes": "c_nationkey",
        "max_logical_workers": "c_custkey % 9",
        "tables": "c_custkey % 7",
        "target_version": "CASE WHEN c_custkey % 2 = 0 THEN 150004 ELSE 160001 END",
        "is_super": "c_mktsegment = 'BUILDING'",
        "has_grant": "c_acctbal > 3000",
    },
)


@query(
    "capacity_headroom",
    with_ctes(FLEET)
    + """SELECT server, concat_ws(',', CASE WHEN used_slots >= max_replication_slots THEN 'slots' END,
      CASE WHEN used_senders >= max_wal_senders THEN 'senders' END, CASE WHEN max_worker_processes < 16 THEN 'workers' END,
      CASE WHEN max_logical_workers < tables + 1 THEN 'logical_workers' END,
      CASE WHEN target_version < 160000 AND NOT is_super THEN 'old_target_grant' END) AS warnings,
      NOT (is_super OR (target_version >= 160000 AND has_grant)) AND target_version >= 160000 AS hard_fail FROM fleet""",
)
def capacity_headroom(spark: SparkSession, folder: str) -> DataFrame:
    out = I.capacity(FLEET.df(spark, folder))
    return out.select("server", F.array_join("warnings", ",").alias("warnings"), "hard_fail")


# --- readiness --------------------------------------------------------------------------------

PROBES = Derived(
    "probes",
    "customer",
    {
        "server": "c_custkey DIV 3",
        "ordinal": "c_custkey",
        "grants": "CASE WHEN c_nationkey % 3 = 0 THEN 'GRANT replication slave ON *.*' WHEN c_nationkey % 3 = 1 THEN "
        "'GRANT Replication Client ON *.*' ELSE 'GRANT SELECT' END",
        "log_bin": "CASE WHEN c_nationkey % 7 = 0 THEN 0 ELSE 1 END",
        "binlog_format": "CASE WHEN c_mktsegment = 'BUILDING' THEN 'STATEMENT' ELSE 'ROW' END",
        "binlog_row_image": "CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE 'FULL' END",
        "gtid_mode": "CASE WHEN c_custkey % 2 = 0 THEN 'ON' ELSE 'OFF' END",
        "binlog_row_value_options": "CASE WHEN c_custkey % 4 = 0 THEN 'PARTIAL_JSON' WHEN c_custkey % 4 = 1 THEN '' END",
        "edition": "CAST(c_nationkey % 9 AS STRING)",
        "tier": pick("c_custkey DIV 3", ["Basic", "S0", "S3", "GP_Gen5_2"]),
    },
)
_FIRST = "first AS (SELECT * FROM probes QUALIFY row_number() OVER (PARTITION BY server ORDER BY ordinal) = 1)"
_EQ = """SELECT server, '{1}' AS label, '{3}' AS severity, coalesce(CAST({0} AS VARCHAR), '') = '{2}' AS ok,
  coalesce(CAST({0} AS VARCHAR), '') AS observed FROM first"""
_TIER = "CASE WHEN edition <> '5' THEN 'ok' WHEN tier IN ('Basic', 'S0', 'S1', 'S2') THEN 'blocked' ELSE 'ok' END"


@query(
    "rule_checks",
    with_ctes(PROBES)
    + f""", {_FIRST}, hay AS (SELECT server, bool_or(contains(lower(grants), 'replication slave')) AS a,
      bool_or(contains(lower(grants), 'replication client')) AS b FROM probes GROUP BY 1)
    SELECT server, 'replication grants' AS label, 'fail' AS severity, a AND b AS ok, CASE WHEN a AND b THEN 'all present' ELSE
      'missing: ' || concat_ws(', ', CASE WHEN NOT a THEN 'REPLICATION SLAVE' END, CASE WHEN NOT b THEN 'REPLICATION CLIENT' END) END AS observed FROM hay
    UNION ALL {_EQ.format("log_bin", "log_bin", "1", "fail")}
    UNION ALL {_EQ.format("binlog_format", "binlog_format", "ROW", "fail")}
    UNION ALL {_EQ.format("binlog_row_image", "binlog_row_image", "FULL", "fail")}
    UNION ALL {_EQ.format("gtid_mode", "gtid_mode", "ON", "warn")}
    UNION ALL SELECT server, 'enforce_gtid_consistency', 'warn', false, '' FROM first
    UNION ALL SELECT server, 'binlog_row_value_options', 'warn', coalesce(binlog_row_value_options, '') = '',
      coalesce(nullif(binlog_row_value_options, ''), '(empty)') FROM first
    UNION ALL SELECT server, 'edition', 'fail', edition IN ('2', '3', '5', '8'), edition FROM first
    UNION ALL SELECT server, 'tier', 'fail', {_TIER} = 'ok', {_TIER} FROM first
    UNION ALL SELECT server, 'is_cdc_enabled', 'fail', false, '' FROM first""",
)
def rule_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Every shipped rule for every server; columns a probe did not return read as empty."""
    probes = PROBES.df(spark, folder).withColumn("tier_ok", Q.tier_verdict(F.col("edition"), F.col("tier")))
    return Q.rule_checks(probes, (*Q.MYSQL_RULES, *Q.SQLSERVER_RULES), "server", "ordinal")


EXPECTED = Derived(
    "expected",
    "orders",
    {"server": "o_custkey", "item": "o_orderkey", "expect": "CASE WHEN o_orderstatus = 'F' THEN 'F' END"},
)
FOUND = Derived(
    "found",
    "lineitem",
    {
        "item": "l_orderkey",
        "value": "l_linestatus",
        "ordinal": "CAST(l_linenumber AS STRING) || lpad(CAST(l_partkey AS STRING), 12, '0') || l_linestatus",
    },
)


@query(
    "existence_checks",
    with_ctes(EXPECTED, FOUND)
    + """, f AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY item ORDER BY ordinal) = 1)
    SELECT e.*, value AS observed, f.item IS NOT NULL AS present,
      CASE WHEN expect IS NOT NULL THEN value IS NOT DISTINCT FROM expect ELSE f.item IS NOT NULL END AS ok
    FROM expected e LEFT JOIN f USING (item)""",
)
def existence_checks(spark: SparkSession, folder: str) -> DataFrame:
    return Q.existence_checks(EXPECTED.df(spark, folder), FOUND.df(spark, folder), ["item"])


CATALOG_TABLES = Derived(
    "catalog_tables",
    "orders",
    {
        "server": "o_custkey",
        "table": "'public.o' || o_orderkey",
        "identity": "CASE o_orderpriority WHEN '1-URGENT' THEN 'n' WHEN '2-HIGH' THEN 'f' WHEN '3-MEDIUM' THEN 'i' ELSE 'd' END",
        "has_key": "o_orderstatus <> 'P'",
        "relkind": "CASE WHEN o_orderkey % 10 = 0 THEN 'p' ELSE 'r' END",
    },
)
_IDENTITY_OK = "((identity = 'd' AND has_key) OR identity IN ('f', 'i'))"


@query(
    "replica_identity",
    with_ctes(CATALOG_TABLES) + f"""SELECT "table", {_IDENTITY_OK} AS ok, relkind = 'p' AS partitioned FROM catalog_tables""",
)
def replica_identity(spark: SparkSession, folder: str) -> DataFrame:
    return CATALOG_TABLES.df(spark, folder).select(
        "table",
        Q.replica_identity_ok(F.col("identity"), F.col("has_key")).alias("ok"),
        (F.col("relkind") == "p").alias("partitioned"),
    )


SHIPPED = CATALOG_TABLES.but(
    "shipped",
    slot_name="CASE WHEN o_custkey % 4 = 0 THEN 'mover' END",
    publication="CASE WHEN o_orderpriority = '5-LOW' THEN 'pub' END",
    relkind="CASE o_orderstatus WHEN 'O' THEN 'r' WHEN 'F' THEN 'p' WHEN 'P' THEN 'v' END",
    wal_level="CASE WHEN o_custkey % 5 = 0 THEN 'replica' WHEN o_custkey % 5 = 1 THEN NULL ELSE 'logical' END",
)
_SHIPPED = """SELECT "table", '{0}' AS "check", '{1}' AS phase, CASE WHEN {3} THEN 'pass' ELSE '{2}' END AS level FROM shipped"""
_SHIPPED_OK = ("slot_name IS NULL", "publication IS NULL", _IDENTITY_OK, "relkind IN ('r', 'p')", "wal_level = 'logical'")


@query(
    "shipped_checks",
    with_ctes(SHIPPED) + " UNION ALL ".join(_SHIPPED.format(*c, ok) for c, ok in zip(Q.SHIPPED_CHECKS, _SHIPPED_OK)),
)
def shipped_checks(spark: SparkSession, folder: str) -> DataFrame:
    return Q.shipped_checks(SHIPPED.df(spark, folder), "table")


CHECKS = Derived(
    "checks", "lineitem", {"server": "l_orderkey", "level": "CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'warn' ELSE 'fail' END"}
)


@query(
    "readiness_verdict",
    with_ctes(CHECKS)
    + """, t AS (SELECT server, count(*) FILTER (WHERE level = 'pass') AS passes, count(*) FILTER (WHERE level = 'warn') AS warns,
      count(*) FILTER (WHERE level = 'fail') AS fails FROM checks GROUP BY 1)
    SELECT *, CASE WHEN fails > 0 THEN 'NOT READY' WHEN warns > 0 THEN 'READY (with warnings)' ELSE 'READY' END AS verdict FROM t""",
)
def readiness_verdict(spark: SparkSession, folder: str) -> DataFrame:
    return Q.readiness(CHECKS.df(spark, folder), "server")


LINTS = Derived(
    "lints",
    "events",
    {
        "server": "user_id",
        "ordinal": "event_id",
        "name": "CASE WHEN value > 60 THEN NULL ELSE 'lint_' || (event_id % 7) END",
        "schema": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'public' END",
        "entity": "props",
        "level": pick("event_id DIV 2", ["INFO", "WARN", "ERROR", "WARN"]),
    },
    where="event_type IN ('error', 'signup')",
)
LINTS_PERF = LINTS.but("lints_perf", where="event_type NOT IN ('error', 'signup')", name="'lint_' || (event_id % 7)")
_RANK = "CASE level WHEN 'INFO' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END"
_DEDUPED = f"""a AS (SELECT * FROM lints UNION ALL SELECT * FROM lints_perf),
  d AS (SELECT server, ordinal, name, coalesce(schema, '') AS schema, entity, level FROM a WHERE name IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY server, name, coalesce(schema, ''), entity ORDER BY {_RANK} DESC, ordinal) = 1)"""


@query("lint_dedupe", with_ctes(LINTS, LINTS_PERF) + f", {_DEDUPED} SELECT * FROM d")
def lint_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    both = LINTS.df(spark, folder).unionByName(LINTS_PERF.df(spark, folder)).filter("name IS NOT NULL")
    return ordered(Q.dedupe_lints(both, ["server"]), "server", F.desc(Q.severity_rank(F.col("level"))))


@query(
    "lint_summary",
    with_ctes(LINTS, LINTS_PERF)
    + f""", {_DEDUPED}, u AS (SELECT server, (CASE WHEN max(CASE WHEN name IS NULL THEN 1 ELSE 0 END) = 0 THEN 1 ELSE 0 END) AS good FROM lints GROUP BY 1
      UNION ALL SELECT server, 1 FROM lints_perf GROUP BY 1),
    f AS (SELECT server, CAST(sum(good) AS BIGINT) AS feeds_ok FROM u GROUP BY 1),
    c AS (SELECT server, count(*) AS total, count(*) FILTER (WHERE level = 'INFO') AS infos, count(*) FILTER (WHERE level = 'WARN') AS warns,
      count(*) FILTER (WHERE level = 'ERROR') AS errors, count(*) FILTER (WHERE {_RANK} >= 2) AS gating FROM d GROUP BY 1)
    SELECT server, feeds_ok, coalesce(total, 0) AS total, coalesce(infos, 0) AS infos, coalesce(warns, 0) AS warns,
      coalesce(errors, 0) AS errors, coalesce(gating, 0) AS gating, feeds_ok > 0 AND coalesce(gating, 0) = 0 AS ok FROM f LEFT JOIN c USING (server)""",
)
def lint_summary(spark: SparkSession, folder: str) -> DataFrame:
    return Q.lint_summary([LINTS.df(spark, folder), LINTS_PERF.df(spark, folder)], "server", "error")


ASSETS = Derived("assets", "orders", {"id": "o_orderkey", "source": "o_orderpriority", "last_synced": "CAST(o_orderdate AS DATE)"})
GUIDES = Derived("guides", "lineitem", {"id": "l_partkey", "source": "l_returnflag", "last_synced": "CAST(l_shipdate AS DATE)"})
_NOW = "1998-08-02"
_AGE = f"CAST(date_diff('day', last_synced, DATE '{_NOW}') AS BIGINT)"


@query(
    "staleness",
    with_ctes(ASSETS, GUIDES)
    + f"""SELECT *, {_AGE} AS age_days, {_AGE} >= 90 AS stale FROM (SELECT * FROM assets UNION ALL SELECT * FROM guides)""",
)
def staleness(spark: SparkSession, folder: str) -> DataFrame:
    """Two catalogs of the same shape as one list."""
    items = ASSETS.df(spark, folder).unionByName(GUIDES.df(spark, folder))
    return ordered(Q.staleness(items, F.lit(_NOW).cast("date")), F.col("age_days").desc_nulls_last())


STEPS = Derived(
    "steps",
    "part",
    {"engine": "p_brand", "ordinal": "p_partkey", "phase": pick("p_partkey", [*Q.PHASE_ORDER[:7], "unknown"])},
)


@query(
    "playbook_rollup",
    with_ctes(STEPS)
    + f""", p AS (SELECT *, list_position({list(Q.PHASE_ORDER)}, phase) - 1 AS i FROM steps WHERE phase <> 'unknown')
    SELECT engine, CAST(i AS INTEGER) AS phase_order, phase, count(*) AS items, min(ordinal) AS first_ordinal FROM p GROUP BY ALL""",
)
def playbook_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return Q.playbook(STEPS.df(spark, folder), "engine")


@query("first_seen", with_ctes(STEPS) + "SELECT engine, min(ordinal) AS first_ordinal FROM steps GROUP BY 1")
def first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """Engines present in a catalog, in order of appearance."""
    return ordered(I.first_seen(STEPS.df(spark, folder), "engine", "ordinal"), "first_ordinal")


PREVIEWS = Derived(
    "previews",
    "customer",
    {
        "server": "c_custkey",
        "expires": "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_nationkey END",
        "now": "10",
        "error_text": "CASE WHEN c_custkey % 5 = 0 THEN 'quota' || c_nationkey || ',region' ELSE '' END",
        "valid": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal > 0 END",
        "warning_text": "CASE WHEN c_custkey % 3 = 0 THEN 'w1' ELSE '' END",
        "member": "CASE WHEN c_custkey % 4 = 0 THEN c_name END",
        "source_plan": pick("c_nationkey", ["free", "pro", "team", "enterprise", "platform", "trial"]),
        "target_plan": pick("c_custkey", ["pro", "team", "free", "enterprise"]),
    },
)
_PLAN = "CASE {0} WHEN 'free' THEN 0 WHEN 'pro' THEN 1 WHEN 'team' THEN 2 WHEN 'enterprise' THEN 3 WHEN 'platform' THEN 4 END"


@query(
    "gate_messages",
    with_ctes(PREVIEWS)
    + f""", m AS (SELECT server, concat_ws(' | ', CASE WHEN expires <= now THEN 'token expired' END,
      CASE WHEN error_text <> '' THEN 'error: ' || replace(error_text, ',', ' | error: ') END,
      CASE WHEN NOT coalesce(valid, false) THEN 'preview not valid' END) AS blockers,
      concat_ws(' | ', nullif(warning_text, ''), 'over limit: ' || member || ' (2)',
        CASE WHEN {_PLAN.format("target_plan")} < {_PLAN.format("source_plan")} THEN 'downgrade ' || source_plan || ' to ' || target_plan END) AS cautions
      FROM previews)
    SELECT *, blockers = '' AS ok FROM m""",
)
def gate_messages(spark: SparkSession, folder: str) -> DataFrame:
    def listed(col: str):
        return F.when(F.col(col) != "", F.split(col, ","))

    member = F.when(F.col("member").isNotNull(), F.array(F.struct(F.col("member").alias("name"), F.lit(2).alias("limit"))))
    rows = PREVIEWS.df(spark, folder).withColumns(
        {"errors": listed("error_text"), "warnings": listed("warning_text"), "members": member}
    )
    out = Q.gate_messages(rows)
    return out.select(
        "server", F.array_join("blockers", " | ").alias("blockers"), F.array_join("cautions", " | ").alias("cautions"), "ok"
    )
