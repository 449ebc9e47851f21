"""Keyed comparisons of two inventories: settings, items, versions, plans, dependencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.functions.scalars import price_note, split_setting, wildcards_regex

# Settings tuned to machine size, items every target has, and risky upgrades.
SIZE_TUNED = (
    "shared_buffers",
    "effective_cache_size",
    "work_mem",
    "maintenance_work_mem",
    "max_connections",
    "max_parallel_workers",
    "max_parallel_workers_per_gather",
    "max_parallel_maintenance_workers",
    "max_worker_processes",
    "max_wal_size",
)
BUILT_IN = ("plpgsql",)
UPGRADE_RISK = {
    "pg_net": "background workers can crash after an upgrade until its UPDATE has run",
    "wrappers": "background workers can crash after an upgrade until its UPDATE has run",
    "pg_cron": "some version pairs have no UPDATE path; confirm one before cutover",
    "pg_repack": "some version pairs have no UPDATE path; confirm one before cutover",
}
# Schemas that the platform manages; ``*`` stands for any run of characters.
MANAGED_SCHEMAS = (
    "_analytics",
    "_realtime",
    "_supavisor",
    "auth",
    "cron",
    "dbdev",
    "etl",
    "extensions",
    "graphql",
    "graphql_public",
    "net",
    "pgbouncer",
    "pgmq",
    "pgsodium",
    "pgsodium_masks",
    "pgtle",
    "realtime",
    "repack",
    "storage",
    "supabase_functions",
    "supabase_migrations",
    "tiger",
    "tiger_data",
    "timescaledb_*",
    "_timescaledb_*",
    "topology",
    "vault",
)


def own_schemas(catalog: DataFrame, schema: str = "schema") -> DataFrame:
    """Catalog rows outside the managed schemas."""
    return catalog.filter(~F.col(schema).rlike(wildcards_regex(MANAGED_SCHEMAS)))


def parse_settings(rows: DataFrame, roles: DataFrame | None = None, databases: DataFrame | None = None) -> DataFrame:
    """(server, scope, key, value) from rows with a ``k=v`` list; entries without ``=`` drop out.

    ``roles`` (role_id, rolname) and ``databases`` (database_id, datname) name the scope; an id
    without a name reads as ``*``.
    """
    if roles is not None:
        rows = rows.join(roles, "role_id", "left")
    if databases is not None:
        rows = rows.join(databases, "database_id", "left")
    scope = F.concat(
        F.coalesce("rolname", F.lit("*")), F.lit("@"), F.coalesce("datname", F.lit("*"))
    )
    exploded = rows.select("server", scope.alias("scope"), F.explode("setconfig").alias("kv"))
    return (
        exploded.withColumn("s", split_setting(F.col("kv")))
        .filter(F.col("s").isNotNull())
        .select("server", "scope", F.col("s.key").alias("key"), F.col("s.value").alias("value"))
    )


def settings_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Settings only on the source, or with another value on the target. Target extras are fine."""
    keys = ["server", "scope", "key"]
    t = target.select(*keys, F.col("value").alias("target_value"), F.lit(True).alias("_there"))
    kind = F.when(F.col("_there").isNull(), "source_only").when(
        ~F.col("value").eqNullSafe(F.col("target_value")), "changed"
    )
    return (
        source.join(t, keys, "left")
        .select(
            *keys,
            F.col("value").alias("source_value"),
            "target_value",
            kind.alias("kind"),
            F.col("key").isin(*SIZE_TUNED).alias("size_tuned"),
        )
        .filter(F.col("kind").isNotNull())
    )


def missing_items(source: DataFrame, target: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Items of the source that the target lacks, without the built-in ones."""
    wanted = source.filter(~F.col(name).isin(*BUILT_IN))
    return wanted.join(target.select(*keys), list(keys), "left_anti").select(*keys)


def version_mismatch(source: DataFrame, target: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Items on both sides with different versions, with a note for upgrades known to be risky."""
    t = target.select(*keys, F.col("version").alias("target_version"))
    risk = F.create_map(*[F.lit(x) for pair in UPGRADE_RISK.items() for x in pair])
    return (
        source.join(t, list(keys))
        .filter(F.col("version") != F.col("target_version"))
        .select(
            *keys,
            F.col("version").alias("source_version"),
            "target_version",
            F.try_element_at(risk, F.col(name)).alias("risk"),
        )
    )


def additive_plan(source: DataFrame, target: DataFrame, scope: str, key: Column) -> DataFrame:
    """Source entries whose key is not on the target; entries without a key are skipped."""
    k = F.nullif(key, F.lit(""))
    have = target.select(scope, k.alias("_key")).filter(F.col("_key").isNotNull())
    return source.withColumn("_key", k).filter(F.col("_key").isNotNull()).join(have, [scope, "_key"], "left_anti")


def provider_body(plan: DataFrame) -> DataFrame:
    """Request body of a planned entry: a URL wins over inline text; blank domains go."""
    has_url = F.nullif("metadata_url", F.lit("")).isNotNull()
    domains = F.filter(F.col("domains"), lambda d: d.isNotNull() & (F.length(d) > 0))
    return plan.select(
        "*",
        F.nullif("metadata_url", F.lit("")).alias("body_url"),
        F.when(~has_url, F.nullif("metadata_xml", F.lit(""))).alias("body_xml"),
        F.when(F.size(domains) > 0, domains).alias("body_domains"),
    )


def upgrade_plan(source: DataFrame, target: DataFrame, scope: str, enabled: Sequence[str]) -> DataFrame:
    """Add-ons whose chosen variant differs from the target's; nothing is ever removed."""
    t = target.select(scope, "addon", F.col("variant").alias("from_variant"))
    return (
        source.filter(F.col("addon").isin(*enabled) & F.col("variant").isNotNull())
        .join(t, [scope, "addon"], "left")
        .filter(~F.col("variant").eqNullSafe(F.col("from_variant")))
        .select(
            scope,
            "addon",
            F.col("variant").alias("to_variant"),
            "from_variant",
            price_note(F.col("amount"), F.col("interval")).alias("price"),
        )
    )


def attribute_changes(source: DataFrame, target: DataFrame, scope: str, attributes: Sequence[str]) -> DataFrame:
    """Which attributes differ per entity, as one flag and a list of names."""
    t = target.select(scope, *[F.col(a).alias(f"_t_{a}") for a in attributes])
    named = [F.when(~F.col(a).eqNullSafe(F.col(f"_t_{a}")), F.lit(a)) for a in attributes]
    return (
        source.join(t, scope)
        .select(scope, F.array_compact(F.array(*named)).alias("changed_attributes"))
        .withColumn("change", F.size("changed_attributes") > 0)
    )


def external_deps(edges: DataFrame, replicated: DataFrame) -> DataFrame:
    """Tables outside the replicated set that replicated tables reference, each once.

    ``edges``: (table, references); ``replicated``: (table). Also gives the schema part.
    """
    outside = (
        edges.join(replicated.select("table"), "table", "left_semi")
        .select("references")
        .distinct()
        .join(replicated.select(F.col("table").alias("references")), "references", "left_anti")
    )
    return outside.withColumn("schema", F.split_part("references", F.lit("."), F.lit(1)))


def unsubscribed(published: DataFrame, subscribed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Published tables that no subscription relation covers."""
    return published.join(subscribed.select(*keys), list(keys), "left_anti")


def identity_plan(maxima: DataFrame, identities: DataFrame, extra: DataFrame) -> DataFrame:
    """Next identity value per owned sequence: the source's largest key plus one.

    ``maxima``: (table, max_value); ``identities``: (sequence, table, next_value); ``extra``
    adds further sequence names. An empty table (null maximum) leaves its sequence alone.
    """
    named = identities.select("sequence").union(extra.select("sequence")).distinct()
    detail = identities.join(maxima, "table", "left")
    return (
        named.join(detail, "sequence", "left")
        .withColumn("resync_to", F.col("max_value") + 1)
        .withColumn("collides", F.coalesce(F.col("next_value") <= F.col("max_value"), F.lit(False)))
    )


def foreign_consumers(slots: DataFrame, ours: Column, server: str = "server") -> DataFrame:
    """Logical slots that are not ours; inactive ones count, they still hold the log."""
    return slots.filter((F.col("slot_type") == "logical") & ~F.col("slot_name").eqNullSafe(ours))


def first_seen(items: DataFrame, name: str, ordinal: str) -> DataFrame:
    """Distinct names with the ordinal of their first appearance."""
    return items.groupBy(name).agg(F.min(ordinal).alias("first_ordinal"))


def capacity(fleet: DataFrame) -> DataFrame:
    """Slot, sender, worker and privilege checks per server pair, as warnings and a hard stop."""
    c = F.col
    warnings = F.array_compact(
        F.array(
            F.when(c("used_slots") >= c("max_replication_slots"), "slots"),
            F.when(c("used_senders") >= c("max_wal_senders"), "senders"),
            F.when(c("max_worker_processes") < 16, "workers"),
            F.when(c("max_logical_workers") < c("tables") + 1, "logical_workers"),
            F.when((c("target_version") < 160000) & ~c("is_super"), "old_target_grant"),
        )
    )
    can_subscribe = c("is_super") | ((c("target_version") >= 160000) & c("has_grant"))
    return fleet.withColumn("warnings", warnings).withColumn(
        "hard_fail", ~can_subscribe & (c("target_version") >= 160000)
    )
