"""Readiness rules compiled to columns, lint roll-ups, staleness and gate messages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.functions.canon import quoted

# Severity and plan ranks, phase order, capture-capable editions, blocked tiers.
SEVERITY = {"INFO": 0, "WARN": 1, "ERROR": 2}
PLAN_RANK = {"free": 0, "pro": 1, "team": 2, "enterprise": 3, "platform": 4}
PHASE_ORDER = (
    "preflight",
    "source-prep",
    "target-prep",
    "snapshot",
    "cdc",
    "reconcile",
    "cutover",
    "teardown",
)
CAPTURE_EDITIONS = ("2", "3", "5", "8")
BLOCKED_TIERS = ("Basic", "S0", "S1", "S2")
STALE_AFTER_DAYS = 90


@dataclass(frozen=True)
class Rule:
    """``eq``, ``one_of`` and ``empty`` look at the first probe row; ``contains`` at all cells."""

    kind: str
    label: str
    column: str | None = None
    values: Sequence[str] = ()
    severity: str = "fail"


# Shipped rules per source engine.
MYSQL_RULES = (
    Rule("contains", "replication grants", values=("REPLICATION SLAVE", "REPLICATION CLIENT")),
    Rule("eq", "log_bin", "log_bin", ("1",)),
    Rule("eq", "binlog_format", "binlog_format", ("ROW",)),
    Rule("eq", "binlog_row_image", "binlog_row_image", ("FULL",)),
    Rule("eq", "gtid_mode", "gtid_mode", ("ON",), "warn"),
    Rule("eq", "enforce_gtid_consistency", "enforce_gtid_consistency", ("ON",), "warn"),
    Rule("empty", "binlog_row_value_options", "binlog_row_value_options", (), "warn"),
)
SQLSERVER_RULES = (
    Rule("one_of", "edition", "edition", CAPTURE_EDITIONS),
    Rule("eq", "tier", "tier_ok", ("ok",)),
    Rule("eq", "is_cdc_enabled", "is_cdc_enabled", ("1",)),
)


def tier_verdict(edition: Column, tier: Column) -> Column:
    """Only the hosted edition (5) has tiers that block change capture."""
    return F.when(edition.cast("string") != "5", "ok").when(tier.isin(*BLOCKED_TIERS), "blocked").otherwise("ok")


def _text(first: Column, name: str, present: Sequence[str]) -> Column:
    value = first[name].cast("string") if name in present else F.lit(None).cast("string")
    return F.coalesce(value, F.lit(""))


def rule_checks(
    probes: DataFrame, rules: Sequence[Rule], by: str, ordinal: str, cells: Sequence[str] | None = None
) -> DataFrame:
    """Evaluate every rule for every server in one aggregation.

    Returns (by, label, severity, ok, observed). ``ordinal`` orders the probe rows of a server;
    only the first row and one flag per searched text leave the map side.
    """
    cells = list(cells) if cells is not None else [c for c in probes.columns if c not in (by, ordinal)]
    hay = F.lower(F.concat_ws(" ", *[quoted(c).cast("string") for c in cells]))
    first_row = F.min_by(F.struct(*[quoted(c) for c in cells]), quoted(ordinal)).alias("_first")
    flags, results = [], []
    for i, rule in enumerate(rules):
        if rule.kind == "contains":
            names = []
            for j, needle in enumerate(rule.values):
                flag = f"_has_{i}_{j}"
                flags.append(F.bool_or(F.contains(hay, F.lit(needle.lower()))).alias(flag))
                names.append(F.when(~F.col(flag), F.lit(needle)))
            lacking = F.array_compact(F.array(*names))
            ok = F.size(lacking) == 0
            seen = F.when(ok, "all present").otherwise(F.concat(F.lit("missing: "), F.array_join(lacking, ", ")))
        else:
            value = _text(F.col("_first"), rule.column, cells)
            if rule.kind == "eq":
                ok, seen = value == rule.values[0], value
            elif rule.kind == "one_of":
                ok, seen = value.isin(*rule.values), value
            elif rule.kind == "empty":
                ok, seen = value == "", F.when(value == "", "(empty)").otherwise(value)
            else:
                raise ValueError(f"unknown rule kind {rule.kind!r}")
        results.append(
            F.struct(
                F.lit(rule.label).alias("label"),
                F.lit(rule.severity).alias("severity"),
                ok.alias("ok"),
                seen.alias("observed"),
            )
        )
    return probes.groupBy(quoted(by)).agg(first_row, *flags).select(by, F.inline(F.array(*results)))


def existence_checks(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected items with ``present``, the first observed value, and ``ok``.

    With an ``expect`` value the observed one must equal it, otherwise presence decides.
    """
    seen = found.groupBy(*keys).agg(F.min_by("value", "ordinal").alias("observed"), F.lit(True).alias("_there"))
    return (
        expected.join(seen, list(keys), "left")
        .withColumn("present", F.col("_there").isNotNull())
        .withColumn(
            "ok",
            F.when(F.col("expect").isNotNull(), F.col("observed").eqNullSafe(F.col("expect"))).otherwise(F.col("present")),
        )
        .drop("_there")
    )


def replica_identity_ok(identity: Column, has_key: Column) -> Column:
    """Updates and deletes replicate with default identity and a key, full rows, or an index."""
    return ((identity == "d") & has_key) | identity.isin("f", "i")


# The shipped checks, as (id, phase, severity).
SHIPPED_CHECKS = (
    ("source.slot_absent", "source-prep", "warn"),
    ("source.publication_absent", "source-prep", "warn"),
    ("source.replica_identity", "source-prep", "fail"),
    ("target.schema_loaded", "target-prep", "fail"),
    ("source.wal_level_logical", "source-prep", "fail"),
)


def shipped_checks(fleet: DataFrame, by: str) -> DataFrame:
    """Evaluate the shipped checks for every table of a fleet, one row per check.

    ``fleet``: (by, slot_name, publication, identity, has_key, relkind, wal_level). A stale
    slot or publication is a finding when it is there; the other checks when they are not met.
    """
    passed = {
        "source.slot_absent": F.col("slot_name").isNull(),
        "source.publication_absent": F.col("publication").isNull(),
        "source.replica_identity": replica_identity_ok(F.col("identity"), F.col("has_key")),
        "target.schema_loaded": F.col("relkind").isin("r", "p"),
        "source.wal_level_logical": F.col("wal_level") == "logical",
    }
    cells = [
        F.struct(
            F.lit(i).alias("check"),
            F.lit(phase).alias("phase"),
            F.when(F.coalesce(passed[i], F.lit(False)), "pass").otherwise(severity).alias("level"),
        )
        for i, phase, severity in SHIPPED_CHECKS
    ]
    return fleet.select(by, F.inline(F.array(*cells)))


def readiness(checks: DataFrame, by: str, level: str = "level") -> DataFrame:
    """Tally of check results and the verdict."""
    out = checks.groupBy(by).agg(
        F.count_if(F.col(level) == "pass").alias("passes"),
        F.count_if(F.col(level) == "warn").alias("warns"),
        # Whatever is neither a pass nor a warning fails.
        F.count_if(F.coalesce(~F.col(level).isin("pass", "warn"), F.lit(True))).alias("fails"),
    )
    return out.withColumn(
        "verdict",
        F.when(F.col("fails") > 0, "NOT READY").when(F.col("warns") > 0, "READY (with warnings)").otherwise("READY"),
    )


def severity_rank(level: Column) -> Column:
    """Rank of a level; an unknown or missing one ranks with the highest, so that it gates."""
    return F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in SEVERITY.items()], F.lit(max(SEVERITY.values())))


def dedupe_lints(lints: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One finding per (name, schema, entity): the most severe, then the earliest.

    ``min_by`` keeps one candidate per task and group, so a finding repeated everywhere does
    not gather on one task.
    """
    keys = [*by, "name", "schema", "entity"]
    rest = [c for c in lints.columns if c not in keys]
    keyed = lints.withColumns({"schema": F.coalesce("schema", F.lit("")), "entity": F.coalesce("entity", F.lit(""))})
    pick = F.min_by(F.struct(*rest), F.struct(-severity_rank(F.col("level")), F.col("ordinal"))).alias("_l")
    return keyed.groupBy(*keys).agg(pick).select(*keys, "_l.*")


def lint_summary(feeds: Sequence[DataFrame], by: str, fail_on: str = "error") -> DataFrame:
    """Totals per level and the number of findings at or above the threshold.

    A feed row with a null name records that the feed failed. With every feed of a group
    failed there is nothing to assert, and the group fails.
    """
    threshold = SEVERITY[fail_on.upper()]
    tagged = [f.withColumn("feed", F.lit(i)) for i, f in enumerate(feeds)]
    everything = tagged[0]
    for f in tagged[1:]:
        everything = everything.unionByName(f)
    # A feed that never reported is as unavailable as one that reported an error.
    failed = F.max(F.when(F.col("name").isNull(), F.lit(1)).otherwise(0))
    usable = (
        everything.groupBy(by, "feed").agg(failed.alias("failed")).groupBy(by).agg(F.count_if(F.col("failed") == 0).alias("feeds_ok"))
    )
    lints = dedupe_lints(everything.filter(F.col("name").isNotNull()).drop("feed"), [by])
    counts = lints.groupBy(by).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("level") == lv).alias(lv.lower() + "s") for lv in SEVERITY],
        F.count_if(severity_rank(F.col("level")) >= threshold).alias("gating"),
    )
    zero = F.lit(0)
    out = usable.join(counts, by, "left")
    for c in ("total", "infos", "warns", "errors", "gating"):
        out = out.withColumn(c, F.coalesce(c, zero))
    return out.withColumn("ok", (F.col("feeds_ok") > 0) & (F.col("gating") == 0))


def staleness(items: DataFrame, now: Column, synced: str = "last_synced", max_age: int = STALE_AFTER_DAYS) -> DataFrame:
    """Age in days against UTC midnight; the limit itself counts as stale."""
    age = F.datediff(now, quoted(synced)).cast("bigint")
    return items.withColumn("age_days", age).withColumn("stale", F.col("age_days") >= max_age)


def playbook(items: DataFrame, by: str) -> DataFrame:
    """Items per phase in running order, empty phases left out."""
    order = F.coalesce(*[F.when(F.col("phase") == p, F.lit(i)) for i, p in enumerate(PHASE_ORDER)])
    return (
        items.withColumn("phase_order", order)
        .filter(F.col("phase_order").isNotNull())
        .groupBy(by, "phase_order", "phase")
        .agg(F.count("*").alias("items"), F.min("ordinal").alias("first_ordinal"))
    )


def gate_messages(previews: DataFrame) -> DataFrame:
    """Blockers and warnings of a takeover preview; an invalid preview always blocks.

    ``previews``: (expires, now, errors array, valid, warnings array, members array of
    (name, limit), source_plan, target_plan).
    """
    c = F.col
    rank = F.create_map(*[F.lit(x) for kv in PLAN_RANK.items() for x in kv])
    listed = F.coalesce(c("errors"), F.array().cast("array<string>"))
    blockers = F.concat(
        F.array_compact(F.array(F.when(c("expires") <= c("now"), F.lit("token expired")))),
        F.transform(listed, lambda e: F.concat(F.lit("error: "), e)),
        F.array_compact(F.array(F.when(~F.coalesce(c("valid"), F.lit(False)), F.lit("preview not valid")))),
    )
    lower = F.try_element_at(rank, c("target_plan")) < F.try_element_at(rank, c("source_plan"))
    warnings = F.concat(
        F.coalesce(c("warnings"), F.array().cast("array<string>")),
        F.transform(
            F.coalesce(c("members"), F.array().cast("array<struct<name:string,limit:int>>")),
            lambda m: F.concat(F.lit("over limit: "), m["name"], F.lit(" ("), m["limit"].cast("string"), F.lit(")")),
        ),
        F.array_compact(
            F.array(F.when(lower, F.concat(F.lit("downgrade "), c("source_plan"), F.lit(" to "), c("target_plan"))))
        ),
    )
    return previews.withColumns({"blockers": blockers, "cautions": warnings}).withColumn("ok", F.size("blockers") == 0)
