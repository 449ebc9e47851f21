"""Scalar expressions: positions, verdicts, key/value text, secrets, endpoints, errors."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Setting names that always hold credentials, and the patterns for the rest.
SECRET_NAMES = (
    "security_captcha_secret",
    "nimbus_oauth_client_secret",
    "rate_limit_email_sent",
    "rate_limit_sms_sent",
)
SECRET_PATTERNS = (
    "^smtp_",
    "^sms_(messagebird|textlocal|twilio|vonage)_",
    "^sms_test_otp",
    "passkey|web_?authn",
    "_secrets?$",
    "^hook_.*_headers?$",
)
JWT_PATTERN = "(?i)jwt[_-]?secret"

# Statement prefixes that read, and connection errors worth a retry.
READ_STATEMENT = r"(?i)^\s*(select|copy|with|show|set|start_replication|fetch)"
TRANSIENT_MESSAGE = (
    "(?i)econnreset|epipe|etimedout|enetunreach|ehostunreach"
    "|connection.*(clos|end|terminat|reset|timeout)"
    "|write connection|read connection|connect_timeout"
    "|connection_(closed|ended|destroyed|connect_timeout)"
)
TRANSIENT_STATE = r"^(08\d\d\d|57P0[123])$"

# Hosted-database host patterns, tested in this order.
PROVIDERS = (
    (r"(?i)(^|\.)supabase\.(co|com)$", None, "supabase"),
    (r"(?i)\.rds\.amazonaws\.com$", r"(?i)\.cluster-(ro-|custom-)?[a-z0-9]+\.", "aurora-postgres"),
    (r"(?i)\.rds\.amazonaws\.com$", None, "rds-postgres"),
    (r"(?i)(^|\.)neon\.tech$", None, "neon"),
    (r"(?i)\.psdb\.cloud$", None, "planetscale-postgres"),
    (r"(?i)\.postgres\.database\.azure\.com$", None, "azure-postgres"),
)
POOLER_HOST = r"(?i)(^|\.)pooler\.supabase\.com$"
DIRECT_HOST = r"(?i)^db\.([a-z0-9]+)\.supabase\.co$"
TRANSACTION_POOLER_PORT = 6543
DEFAULT_PORT = 5432

MEGABYTE = 1_048_576


def lsn_position(lsn: Column) -> Column:
    """``X/Y`` hexadecimal log position as an unsigned 64-bit number."""
    high = F.conv(F.split_part(lsn, F.lit("/"), F.lit(1)), 16, 10).cast("decimal(20,0)")
    low = F.conv(F.split_part(lsn, F.lit("/"), F.lit(2)), 16, 10).cast("decimal(20,0)")
    return (high * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("decimal(20,0)")


def binlog_position(file_pos: Column) -> Column:
    """``file:pos`` as a struct that orders by the file's base name, its number, then the offset.

    The number is compared as a number, so a file whose number has outgrown its padding still comes later.
    """
    return F.struct(
        F.regexp_extract(file_pos, r"^(.*?)(?:\.([0-9]+))?:([0-9]+)$", 1).alias("base"),
        F.regexp_extract(file_pos, r"^(.*?)(?:\.([0-9]+))?:([0-9]+)$", 2).try_cast("bigint").alias("number"),
        F.regexp_extract(file_pos, "^(.*):([0-9]+)$", 2).try_cast("bigint").alias("pos"),
    )


def binary_position(value: Column) -> Column:
    """Binary position as lower-case hex; null reads as the text ``NULL``, which is stable."""
    return F.coalesce(F.lower(F.hex(value)), F.lit("NULL"))


def clamp(bytes_col: Column) -> Column:
    """Lag can be briefly negative while a slot is recreated; that means zero."""
    return F.greatest(F.lit(0).cast("bigint"), bytes_col.cast("bigint"))


def megabytes(bytes_col: Column) -> Column:
    return F.round(bytes_col.cast("double") / MEGABYTE, 0).cast("bigint")


def retention_verdict(elapsed: Column, retention: Column, warn_fraction: float = 0.8) -> Column:
    """ok / warn / abort from the share of the source's change-log retention already used."""
    used = elapsed.cast("double") / F.nullif(retention.cast("double"), F.lit(0.0))
    return (
        F.when(retention.isNull() | (retention <= 0), "ok")
        .when(used >= 1, "abort")
        .when(used >= warn_fraction, "warn")
        .otherwise("ok")
    )


def retained_verdict(retained_bytes: Column, wal_status: Column, max_mb: float = 2048) -> Column:
    """abort when the slot is lost or over the limit; warn for any other unhealthy status."""
    return (
        F.when(wal_status == "lost", "abort")
        .when(retained_bytes.cast("double") / MEGABYTE > max_mb, "abort")
        .when(wal_status.isNull() | ~wal_status.isin("reserved", "extended"), "warn")
        .otherwise("ok")
    )


def is_secret(key: Column) -> Column:
    """Does a setting name hold a credential?"""
    return key.isin(*SECRET_NAMES) | key.rlike("|".join(SECRET_PATTERNS))


def is_sensitive(key: Column) -> Column:
    """Secret, or a signing key in any section."""
    return is_secret(key) | key.rlike(JWT_PATTERN)


def split_setting(kv: Column) -> Column:
    """(key, value) split at the first ``=``; null when there is none."""
    pattern = "(?s)^([^=]*)=(.*)$"
    return F.when(
        F.instr(kv, "=") > 0,
        F.struct(
            F.regexp_extract(kv, pattern, 1).alias("key"), F.regexp_extract(kv, pattern, 2).alias("value")
        ),
    )


def mask_url_password(text: Column) -> Column:
    """Mask the password of every database URL inside a log text."""
    return F.regexp_replace(text, r"(?i)\b(postgres(?:ql)?://[^:/@\s]*):([^@/\s]+)@", "$1:***@")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^:/?#]+)", 1))


def url_port(url: Column) -> Column:
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?[^:/?#]+:([0-9]+)", 1)
    return F.coalesce(F.nullif(port, F.lit("")).cast("int"), F.lit(DEFAULT_PORT))


def url_user(url: Column) -> Column:
    """Percent-decoded user of a connection URL."""
    return F.url_decode(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^:@/]*)[^@/]*@", 1))


def url_database(url: Column) -> Column:
    """Percent-decoded database name of a connection URL."""
    return F.url_decode(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/([^?#]*)", 1))


def provider_of(host: Column) -> Column:
    """Hosting provider of a database host; the cluster form is tested before the plain one."""
    out = None
    for pattern, marker, provider in PROVIDERS:
        hit = host.rlike(pattern)
        if marker:
            hit = hit & host.rlike(marker)
        out = F.when(hit, provider) if out is None else out.when(hit, provider)
    return out.otherwise("generic")


def is_write_statement(query: Column) -> Column:
    return ~query.rlike(READ_STATEMENT)


def is_transient(message: Column, state: Column) -> Column:
    """Connection-shaped failure, by message or by SQL state."""
    return F.coalesce(message.rlike(TRANSIENT_MESSAGE), F.lit(False)) | F.coalesce(
        state.rlike(TRANSIENT_STATE), F.lit(False)
    )


def health_is_up(body: Column, check: str = "debezium") -> tuple[Column, Column]:
    """(overall up, named check up) of a health document; invalid documents are down."""
    doc = F.from_json(body, "status string, checks array<struct<name:string,status:string>>")
    up = F.coalesce(doc["status"] == "UP", F.lit(False))
    named = F.filter(F.coalesce(doc["checks"], F.array()), lambda c: c["name"] == check)
    first = F.get(named, F.lit(0))
    return up, F.when(F.size(named) > 0, F.coalesce(first["status"] == "UP", F.lit(False))).otherwise(up)


def env_line(line: Column) -> Column:
    """(key, value) of one ``KEY=value`` line; null for comments, blanks and bad names."""
    body = F.trim(line)
    body = F.regexp_replace(body, r"^export\s+", "")
    key = F.trim(F.regexp_extract(body, r"^([^=]+)=(.*)$", 1))
    raw = F.trim(F.regexp_extract(body, r"^([^=]+)=(.*)$", 2))
    value = F.when(raw.rlike('(?s)^".*"$') & (F.length(raw) > 1), raw.substr(F.lit(2), F.length(raw) - 2)).when(
        raw.rlike("(?s)^'.*'$") & (F.length(raw) > 1), raw.substr(F.lit(2), F.length(raw) - 2)
    ).otherwise(F.when(raw.isin('"', "'"), "").otherwise(raw))
    return F.when(
        ~F.trim(line).startswith("#") & key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"),
        F.struct(key.alias("key"), value.alias("value")),
    )


def price_note(amount: Column, interval: Column) -> Column:
    plain = F.regexp_replace(amount.cast("decimal(20,6)").cast("string"), r"\.?0+$", "")
    return F.when(amount.isNull(), "price n/a").otherwise(
        F.format_string("$%s/%s", F.when(amount == 0, "0").otherwise(plain), F.coalesce(interval, F.lit("?")))
    )


def cut_fraction(time_text: Column, digits: int = 6) -> Column:
    """Time text with at most ``digits`` fractional digits; more are cut, not rounded."""
    return F.regexp_replace(time_text, r"(\.\d{%d})\d+" % digits, "$1")


def sql_identifier(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def tokens(text: Column) -> Column:
    """Distinct lower-case word tokens in order of first appearance; the derived search column."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 0))


def wildcards_regex(patterns: Sequence[str]) -> str:
    """One anchored regex for names where ``*`` stands for any run of characters."""
    return "^(" + "|".join(".*".join(re.escape(p) for p in pat.split("*")) for pat in patterns) + ")$"
