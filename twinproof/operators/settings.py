"""Settings payloads and log texts: redaction, stripping, reshaping and masking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.functions import scalars as S

# Storage keys that describe the platform, and the signing key never copied.
STORAGE_KEYS = ("capabilities", "migrationVersion", "databasePoolMode", "features")
SIGNING_KEY = "jwt_secret"
MASK = "****"


def strip_secrets(settings: Column, copy_secrets: bool = False) -> Column:
    """A settings map without credentials, unless they were asked for."""
    return settings if copy_secrets else F.map_filter(settings, lambda k, v: ~S.is_secret(k))


def redact(settings: Column) -> Column:
    """A settings map fit for display."""
    return F.transform_values(settings, lambda k, v: F.when(S.is_sensitive(k), F.lit(MASK)).otherwise(v))


def drop_nulls(settings: Column, drop: Sequence[str] = ()) -> Column:
    """A settings map without null values and without the listed keys."""
    if not drop:
        return F.map_filter(settings, lambda k, v: v.isNotNull())
    return F.map_filter(settings, lambda k, v: v.isNotNull() & ~k.isin(*drop))


def strip_keys(settings: Column, drop: Sequence[str]) -> Column:
    return F.map_filter(settings, lambda k, v: ~k.isin(*drop))


def api_settings(settings: Column) -> Column:
    """API settings: the signing key always goes, then nulls."""
    return drop_nulls(settings, [SIGNING_KEY])


_PAYLOAD = (
    "config struct<dbAllowedCidrs:array<string>,dbAllowedCidrsV6:array<string>>,"
    "currentConfig struct<database:boolean>,"
    "secrets array<struct<name:string,value:string>>"
)


def reshape(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Lift the parts of a JSON payload: address lists, a coerced flag, well-formed pairs."""
    doc = F.from_json(body, _PAYLOAD)
    pairs = F.filter(
        F.coalesce(doc["secrets"], F.array()), lambda s: s["name"].isNotNull() & s["value"].isNotNull()
    )
    return payloads.withColumns(
        {
            "cidrs": doc["config"]["dbAllowedCidrs"],
            "cidrs_v6": doc["config"]["dbAllowedCidrsV6"],
            "database_ssl": F.coalesce(doc["currentConfig"]["database"], F.lit(False)),
            "secrets": pairs,
        }
    )


def mask_log(log: DataFrame, line: str = "line") -> DataFrame:
    return log.withColumn(line, S.mask_url_password(F.col(line)))


def classify_endpoints(connections: DataFrame, url: str = "url") -> DataFrame:
    """Provider, pooler and direct-host flags of each connection URL.

    ``can_replicate`` is false for poolers, which cannot stream the log.
    """
    host = S.url_host(F.col(url))
    port = S.url_port(F.col(url))
    out = connections.withColumns(
        {"host": host, "port": port, "user": S.url_user(F.col(url)), "database": S.url_database(F.col(url))}
    )
    h = F.col("host")
    return out.withColumns(
        {
            "provider": S.provider_of(h),
            "is_pooler": h.rlike(S.POOLER_HOST),
            "is_transaction_pooler": h.rlike(S.POOLER_HOST) & (F.col("port") == S.TRANSACTION_POOLER_PORT),
            "is_direct": h.rlike(S.DIRECT_HOST),
            "ref": F.when(h.rlike(S.DIRECT_HOST), F.regexp_extract(h, S.DIRECT_HOST, 1)),
        }
    ).withColumns(
        {"can_replicate": ~F.col("is_pooler"), "is_hosted": F.col("is_pooler") | F.col("is_direct")}
    )


def parse_env(lines: DataFrame, line: str = "line") -> DataFrame:
    """Key/value pairs of env-file lines; malformed lines drop out."""
    return (
        lines.withColumn("_kv", S.env_line(F.col(line)))
        .filter(F.col("_kv").isNotNull())
        .select("*", F.col("_kv.key").alias("key"), F.col("_kv.value").alias("value"))
        .drop("_kv", line)
    )
