from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from twinproof.functions import scalars as S
from twinproof.operators import inventory as I
from twinproof.operators import rules as Q
from twinproof.operators import settings as C
from twinproof.operators.profile import category_of_name
from twinproof.sources import catalog


def tuples(df, *cols):
    return {tuple(r) for r in (df.select(*cols) if cols else df).collect()}


# --- settings -----------------------------------------------------------------------------------

ROLE = "server int, rolname string, datname string, setconfig array<string>"
SETTING = "server int, scope string, key string, value string"


def test_parse_settings(spark):
    rows = spark.createDataFrame(
        [(1, "app", None, ["search_path=a=b", "noequalsign", "=odd"]), (1, None, "db", ["x=1"]), (1, "none", None, None)], ROLE
    )
    assert tuples(I.parse_settings(rows)) == {
        (1, "app@*", "search_path", "a=b"), (1, "app@*", "", "odd"), (1, "*@db", "x", "1"),
    }


def test_settings_diff(spark):
    s = spark.createDataFrame([(1, "*@*", "work_mem", "64MB"), (1, "*@*", "lost", "1"), (1, "*@*", "same", "x")], SETTING)
    t = spark.createDataFrame([(1, "*@*", "work_mem", "1GB"), (1, "*@*", "same", "x"), (1, "*@*", "extra", "y")], SETTING)
    got = tuples(I.settings_diff(s, t), "key", "kind", "size_tuned")
    assert got == {("work_mem", "changed", True), ("lost", "source_only", False)}


SECRETS = [
    "security_captcha_secret", "nimbus_oauth_client_secret", "rate_limit_email_sent", "rate_limit_sms_sent", "smtp_pass", "smtp_host",
    "sms_twilio_auth_token", "sms_vonage_api_key", "sms_test_otp", "passkey_enabled", "webauthn_rp", "web_authn_rp",
    "external_google_secret", "hook_send_sms_secrets", "hook_custom_access_token_headers", "hook_x_header",
]
KEPT = ["sessions_single_per_user", "db_max_pool_size", "hook_send_sms_enabled", "hook_send_sms_uri", "site_url", "secret_free", "sms_provider"]


def settings_map(spark, keys):
    return spark.createDataFrame([({k: "v" for k in keys},)], "m map<string,string>")


def test_every_secret_goes_and_behaviour_stays(spark):
    df = settings_map(spark, SECRETS + KEPT)
    assert set(df.select(C.strip_secrets(F.col("m"))).first()[0]) == set(KEPT)
    assert set(df.select(C.strip_secrets(F.col("m"), copy_secrets=True)).first()[0]) == set(SECRETS + KEPT)
    shown = df.select(C.redact(F.col("m"))).first()[0]
    assert {k for k, v in shown.items() if v == "****"} == set(SECRETS)


def test_signing_key_always_goes(spark):
    df = spark.createDataFrame([({"jwt_secret": "s", "max_rows": "5", "empty": None, "features": "f"},)], "m map<string,string>")
    assert df.select(C.api_settings(F.col("m"))).first()[0] == {"max_rows": "5", "features": "f"}
    assert set(df.select(C.strip_keys(F.col("m"), C.STORAGE_KEYS)).first()[0]) == {"jwt_secret", "max_rows", "empty"}
    assert df.select(C.redact(F.col("m"))).first()[0]["jwt_secret"] == "****"


def test_reshape(spark):
    bodies = [
        '{"config":{"dbAllowedCidrs":["1.2.3.4/32"]}}', '{"currentConfig":{"database":true}}', "{}", '{"currentConfig":{"database":null}}',
        '{"secrets":[{"name":"A","value":"1"},{"name":"B"},{"value":"2"}]}',
    ]
    out = C.reshape(spark.createDataFrame(list(enumerate(bodies)), "i int, body string")).orderBy("i").collect()
    assert out[0]["cidrs"] == ["1.2.3.4/32"] and out[0]["cidrs_v6"] is None
    assert [r["database_ssl"] for r in out] == [False, True, False, False, False]
    assert [tuple(s) for s in out[4]["secrets"]] == [("A", "1")]


@pytest.mark.parametrize(
    "line, want",
    [
        ("A=1", ("A", "1")), ("  export B = 'x y' ", ("B", "x y")), ('C="q=1"', ("C", "q=1")), ("# D=1", None), ("", None), ("=x", None),
        ("9E=1", None), ("F=", ("F", "")), ("G", None), ("H=\"open", ("H", '"open')), ("I=a#b", ("I", "a#b")),
    ],
)
def test_env_line(spark, line, want):
    got = [(r["key"], r["value"]) for r in C.parse_env(spark.createDataFrame([(line,)], "line string")).collect()]
    assert got == ([want] if want else [])


@pytest.mark.parametrize(
    "line, want",
    [
        ("x postgres://u:p@h/d y", "x postgres://u:***@h/d y"), ("postgresql://u:p%40q@h", "postgresql://u:***@h"),
        ("postgres://h/d", "postgres://h/d"), ("postgres://u@h", "postgres://u@h"), ("https://u:p@h", "https://u:p@h"),
    ],
)
def test_mask(spark, line, want):
    assert C.mask_log(spark.createDataFrame([(line,)], "line string")).first()["line"] == want


@pytest.mark.parametrize(
    "url, provider, pooler, transaction, direct, ref",
    [
        ("postgres://u:p@db.abc123.supabase.co:5432/x", "supabase", False, False, True, "abc123"),
        ("postgres://u:p@aws-0.pooler.supabase.com:6543/x", "supabase", True, True, False, None),
        ("postgres://u:p@aws-0.pooler.supabase.com/x", "supabase", True, False, False, None),
        ("postgres://u@c.cluster-abc.eu.rds.amazonaws.com/x", "aurora-postgres", False, False, False, None),
        ("postgres://u@c.abc.eu.rds.amazonaws.com/x", "rds-postgres", False, False, False, None),
        ("postgres://u@ep.eu.neon.tech/x", "neon", False, False, False, None),
        ("postgres://u@x.horizon.psdb.cloud/x", "planetscale-postgres", False, False, False, None),
        ("postgres://u@x.postgres.database.azure.com/x", "azure-postgres", False, False, False, None),
        ("postgres://u@notsupabase.co.example.com/x", "generic", False, False, False, None),
    ],
)
def test_endpoints(spark, url, provider, pooler, transaction, direct, ref):
    r = C.classify_endpoints(spark.createDataFrame([(url,)], "url string")).first()
    assert (r["provider"], r["is_pooler"], r["is_transaction_pooler"], r["is_direct"], r["ref"]) == (provider, pooler, transaction, direct, ref)
    assert r["can_replicate"] is not pooler and r["is_hosted"] is (pooler or direct)


def test_url_parts_are_decoded(spark):
    r = C.classify_endpoints(spark.createDataFrame([("mysql://us%40er:p%3Aw@h:3307/my%20db?x=1",)], "url string")).first()
    assert (r["user"], r["host"], r["port"], r["database"]) == ("us@er", "h", 3307, "my db")


def test_transient(spark):
    rows = [("read ECONNRESET", None, True), ("connection timeout", None, True), ("bad query", "08006", True), ("x", "57P03", True), ("x", "57P04", False), ("syntax", "42601", False), (None, None, False)]
    df = spark.createDataFrame(rows, "m string, s string, want boolean")
    assert df.filter(S.is_transient(F.col("m"), F.col("s")) != F.col("want")).count() == 0


def test_write_statements(spark):
    df = spark.createDataFrame([("INSERT x", True), ("  Select 1", False), ("with a", False), ("START_REPLICATION s", False), ("delete", True)], "q string, want boolean")
    assert df.filter(S.is_write_statement(F.col("q")) != F.col("want")).count() == 0


# --- inventories --------------------------------------------------------------------------------


def test_missing_items_and_versions(spark):
    s = spark.createDataFrame([(1, "pg_net", "0.9.0"), (1, "plpgsql", "1.0"), (1, "citext", "1.6"), (1, "only", "1")], "server int, item string, version string")
    t = spark.createDataFrame([(1, "pg_net", "0.14.0"), (1, "citext", "1.6")], "server int, item string, version string")
    assert tuples(I.missing_items(s, t, ["server", "item"], "item")) == {(1, "only")}
    got = I.version_mismatch(s, t, ["server", "item"], "item").collect()
    assert [(r["item"], r["source_version"], r["target_version"]) for r in got] == [("pg_net", "0.9.0", "0.14.0")] and got[0]["risk"]


def test_additive_plan(spark):
    ddl = "p int, id int, issuer string, jwks string"
    s = spark.createDataFrame([(1, 1, "i1", None), (1, 2, None, "j2"), (1, 3, None, None), (1, 4, "i4", "j4"), (2, 5, "i1", None)], ddl)
    t = spark.createDataFrame([(1, 9, "i1", None), (1, 8, None, "i4")], ddl)
    got = {r["id"] for r in I.additive_plan(s, t, "p", F.coalesce("issuer", "jwks")).collect()}
    assert got == {2, 5}


def test_provider_body(spark):
    ddl = "id int, metadata_url string, metadata_xml string, domains array<string>"
    rows = [(1, "u", "x", ["a", None, ""]), (2, None, "x", None), (3, "", "x", [""])]
    got = {r["id"]: (r["body_url"], r["body_xml"], r["body_domains"]) for r in I.provider_body(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {1: ("u", None, ["a"]), 2: (None, "x", None), 3: (None, "x", None)}


def test_upgrade_plan(spark):
    ddl = "p int, addon string, variant string, amount double, interval string"
    s = spark.createDataFrame([(1, "pitr", "v7", 100.0, "monthly"), (1, "ipv4", "on", None, None), (1, "compute_instance", None, None, None), (2, "pitr", "v7", 1.5, None)], ddl)
    t = spark.createDataFrame([(1, "pitr", "v3", None, None), (1, "ipv4", "on", None, None), (1, "compute_instance", "big", None, None)], ddl)
    got = tuples(I.upgrade_plan(s, t, "p", ["pitr", "ipv4", "compute_instance"]), "p", "addon", "from_variant", "price")
    assert got == {(1, "pitr", "v3", "$100/monthly"), (2, "pitr", None, "$1.5/?")}


def test_attribute_changes(spark):
    ddl = "s int, size int, iops int"
    a, b = [(1, 8, 10), (2, 8, None), (3, 8, None)], [(1, 8, 10), (2, 9, None), (3, 8, 5)]
    out = I.attribute_changes(spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl), "s", ["size", "iops"])
    assert {r["s"]: r["changed_attributes"] for r in out.collect()} == {1: [], 2: ["size"], 3: ["iops"]}


def test_external_deps(spark):
    edges = spark.createDataFrame([("public.d", "auth.users"), ("public.e", "auth.users"), ("public.e", "public.d"), ("x.y", "z.z")], "table string, references string")
    mine = spark.createDataFrame([("public.d",), ("public.e",)], "table string")
    assert tuples(I.external_deps(edges, mine)) == {("auth.users", "auth")}


def test_foreign_consumers(spark):
    df = spark.createDataFrame([("ours", "logical", True), ("cdc", "logical", False), ("copy", "physical", True)], "slot_name string, slot_type string, active boolean")
    assert tuples(I.foreign_consumers(df, F.lit("ours")), "slot_name") == {("cdc",)}


def test_identity_plan(spark):
    maxima = spark.createDataFrame([("a", 10), ("b", None)], "table string, max_value bigint")
    ids = spark.createDataFrame([("a_seq", "a", 5), ("b_seq", "b", 1)], "sequence string, table string, next_value bigint")
    extra = spark.createDataFrame([("a_seq",), ("m_seq",)], "sequence string")
    got = {r["sequence"]: (r["resync_to"], r["collides"]) for r in I.identity_plan(maxima, ids, extra).collect()}
    assert got == {"a_seq": (11, True), "b_seq": (None, False), "m_seq": (None, False)}


# --- rules --------------------------------------------------------------------------------------


def test_rule_kinds(spark):
    rows = [(1, 0, "GRANT replication slave", "1", ""), (1, 1, "grant REPLICATION CLIENT", "0", "x"), (2, 0, "GRANT SELECT", "0", "PARTIAL_JSON"), (2, 1, None, "1", None)]
    df = spark.createDataFrame(rows, "server int, ordinal int, grants string, log_bin string, opts string")
    rules = (
        Q.Rule("contains", "grants", values=("REPLICATION SLAVE", "REPLICATION CLIENT")),
        Q.Rule("eq", "bin", "log_bin", ("1",)),
        Q.Rule("one_of", "either", "log_bin", ("1", "2")),
        Q.Rule("empty", "opts", "opts", (), "warn"),
        Q.Rule("empty", "absent", "no_such_column"),
    )
    got = {(r["server"], r["label"]): (r["ok"], r["observed"]) for r in Q.rule_checks(df, rules, "server", "ordinal").collect()}
    assert got[(1, "grants")] == (True, "all present") and got[(2, "grants")][1] == "missing: REPLICATION SLAVE, REPLICATION CLIENT"
    assert got[(1, "bin")] == (True, "1") and got[(2, "bin")] == (False, "0") and got[(1, "either")][0] and not got[(2, "either")][0]
    assert got[(1, "opts")] == (True, "(empty)") and got[(2, "opts")] == (False, "PARTIAL_JSON") and got[(2, "absent")][0]
    with pytest.raises(ValueError):
        Q.rule_checks(df, [Q.Rule("odd", "x", "grants")], "server", "ordinal")


def test_tiers(spark):
    df = spark.createDataFrame([("5", "Basic", "blocked"), ("5", "S3", "ok"), ("8", "Basic", "ok"), ("5", None, "ok")], "e string, t string, want string")
    assert df.filter(Q.tier_verdict(F.col("e"), F.col("t")) != F.col("want")).count() == 0


def test_readiness(spark):
    df = spark.createDataFrame([("a", "pass"), ("b", "warn"), ("b", "pass"), ("c", "fail"), ("c", "warn")], "s string, level string")
    assert {r["s"]: r["verdict"] for r in Q.readiness(df, "s").collect()} == {"a": "READY", "b": "READY (with warnings)", "c": "NOT READY"}


LINT = "server int, ordinal int, name string, schema string, entity string, level string"
LINTS = [(1, 1, "rls", "public", "a", "ERROR"), (1, 2, "rls", "public", "b", "ERROR"), (1, 3, "idx", "public", "a", "WARN"), (1, 4, "nit", None, None, "INFO")]


@pytest.mark.parametrize("fail_on, gating", [("error", 2), ("warn", 3), ("info", 4)])
def test_lint_gating(spark, fail_on, gating):
    feed = spark.createDataFrame(LINTS + [(1, 9, "rls", "public", "a", "ERROR")], LINT)
    r = Q.lint_summary([feed, feed.filter("false")], "server", fail_on).first()
    assert (r["total"], r["errors"], r["warns"], r["infos"], r["gating"], r["ok"]) == (4, 2, 1, 1, gating, False)


def test_unknown_levels_gate(spark):
    odd = spark.createDataFrame([(1, 1, "x", None, "e", "ERROR"), (1, 0, "x", None, "e", None), (2, 1, "y", None, "e", "FATAL"), (3, 1, "z", None, "e", "INFO")], LINT)
    got = {r["server"]: (r["gating"], r["ok"]) for r in Q.lint_summary([odd], "server").collect()}
    assert got == {1: (1, False), 2: (1, False), 3: (0, True)}
    checks = spark.createDataFrame([("a", "pass"), ("a", None), ("b", "broken")], "s string, level string")
    assert {r["verdict"] for r in Q.readiness(checks, "s").collect()} == {"NOT READY"}


def test_failed_feeds(spark):
    failed = spark.createDataFrame([(1, 0, None, None, None, None)], LINT)
    good = spark.createDataFrame([(1, 0, "nit", None, None, "INFO")], LINT)
    assert Q.lint_summary([good, failed], "server").first()["ok"]
    assert not Q.lint_summary([failed, failed], "server").first()["ok"]


def test_dedupe_keeps_the_most_severe(spark):
    df = spark.createDataFrame([(1, 1, "x", None, "e", "WARN"), (1, 2, "x", "", "e", "ERROR"), (1, 3, "x", "", "e", "ERROR")], LINT)
    r = Q.dedupe_lints(df).collect()
    assert len(r) == 1 and (r[0]["level"], r[0]["ordinal"]) == ("ERROR", 2)


def test_staleness_limit_counts(spark):
    df = spark.createDataFrame([("a", "2026-03-26"), ("b", "2026-03-27")], "id string, d string").withColumn("last_synced", F.to_date("d"))
    got = {r["id"]: (r["age_days"], r["stale"]) for r in Q.staleness(df, F.to_date(F.lit("2026-06-24"))).collect()}
    assert got == {"a": (90, True), "b": (89, False)}


def test_existence_checks(spark):
    want = spark.createDataFrame([("a", None), ("b", "logical"), ("c", "logical"), ("d", None)], "k string, expect string")
    seen = spark.createDataFrame([("a", "x", 1), ("b", "logical", 1), ("b", "zzz", 2), ("c", "replica", 1)], "k string, value string, ordinal int")
    got = {r["k"]: (r["present"], r["ok"]) for r in Q.existence_checks(want, seen, ["k"]).collect()}
    assert got == {"a": (True, True), "b": (True, True), "c": (True, False), "d": (False, False)}


def test_replica_identity(spark):
    df = spark.createDataFrame([("d", True, True), ("d", False, False), ("f", False, True), ("i", False, True), ("n", True, False)], "i string, k boolean, want boolean")
    assert df.filter(Q.replica_identity_ok(F.col("i"), F.col("k")) != F.col("want")).count() == 0


def test_capacity(spark):
    row = dict(server=1, max_replication_slots=5, used_slots=5, max_wal_senders=5, used_senders=4, max_worker_processes=8, max_logical_workers=4, tables=4, target_version=160001, is_super=False, has_grant=False)
    df = spark.createDataFrame([row])
    r = I.capacity(df).first()
    assert r["warnings"] == ["slots", "workers", "logical_workers"] and r["hard_fail"]
    old = I.capacity(df.withColumn("target_version", F.lit(150004))).first()
    assert "old_target_grant" in old["warnings"] and not old["hard_fail"]


def test_gate_messages(spark):
    ddl = (
        "id int, expires int, now int, errors array<string>, valid boolean, warnings array<string>, "
        "members array<struct<name:string,limit:int>>, source_plan string, target_plan string"
    )
    rows = [
        (1, 50, 10, None, True, None, None, "free", "pro"),
        (2, 10, 10, ["k"], False, ["w"], [("m", 2)], "team", "pro"),
        (3, None, 10, None, None, None, None, "odd", "free"),
    ]
    got = {r["id"]: (r["ok"], r["blockers"], r["cautions"]) for r in Q.gate_messages(spark.createDataFrame(rows, ddl)).collect()}
    assert got[1] == (True, [], []) and got[3] == (False, ["preview not valid"], [])
    assert got[2] == (False, ["token expired", "error: k", "preview not valid"], ["w", "over limit: m (2)", "downgrade team to pro"])


def test_playbook(spark):
    df = spark.createDataFrame([("m", 3, "cutover"), ("m", 1, "cdc"), ("m", 2, "cdc"), ("m", 4, "nowhere")], "engine string, ordinal int, phase string")
    got = [(r["phase"], r["items"]) for r in Q.playbook(df, "engine").orderBy("phase_order").collect()]
    assert got == [("cdc", 2), ("cutover", 1)]


# --- catalogs -----------------------------------------------------------------------------------


def test_hash_column_audit(spark):
    live = spark.createDataFrame([("t", "id", False), ("t", "new", False), ("t", "tsv", True), ("auto", "id", False)], "table_id string, column_name string, is_generated boolean")
    pinned = spark.createDataFrame([("t", "id"), ("t", "gone"), ("t", "tsv")], "table_id string, column_name string")
    assert tuples(catalog.hash_column_audit(live, pinned)) == {
        ("t", "new", "missing_from_pinned"), ("t", "gone", "nonexistent"), ("t", "tsv", "generated_pinned"),
    }


def test_key_order_is_index_order(spark):
    idx = spark.createDataFrame([("t", True, [3, 1]), ("t", False, [2])], "table_id string, is_primary boolean, attnums array<int>")
    cols = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b"), ("t", 3, "c")], "table_id string, attnum int, column_name string")
    got = [r["column_name"] for r in catalog.key_columns(idx, cols).orderBy("key_position").collect()]
    assert got == ["c", "a"]


def test_live_catalog(spark, data):
    from twinproof.sources.tables import load

    df = catalog.catalog_of(spark, {"orders": load(spark, data, "orders")})
    assert [r["column_name"] for r in df.orderBy("ordinal").collect()][0] == "o_orderkey"


def test_interval_is_temporal(spark):
    df = spark.createDataFrame([("interval", "temporal"), ("int4", "numeric"), ("uuid", "text"), ("bytea", "other"), ("bool", "boolean")], "t string, want string")
    assert df.filter(category_of_name(F.col("t")) != F.col("want")).count() == 0


def test_reports_come_in_a_total_order(spark, data):
    from twinproof.plans import catalogue

    ages = [r["age_days"] for r in catalogue.QUERIES["staleness"](spark, data).collect()]
    known = [a for a in ages if a is not None]
    assert known == sorted(known, reverse=True) and ages[: len(known)] == known
    rank = {"ERROR": 2, "WARN": 1, "INFO": 0}
    lints = [(r["server"], -rank[r["level"]]) for r in catalogue.QUERIES["lint_dedupe"](spark, data).collect()]
    assert lints == sorted(lints)
    schemas = [r["schema"] for r in catalogue.QUERIES["external_schemas"](spark, data).collect()]
    assert schemas == sorted(schemas)
