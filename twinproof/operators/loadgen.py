"""Deterministic load: seeds, mixed changes and churn, driven by a frame of ids.

``spark.range`` gives the ids for a fresh load; any table's key column works as well. Every
choice is a hash of the id, so a rerun gives the same rows and tasks need no coordination.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.functions.scalars import tokens

# Load ratios, in percent, and the enumerations of the adversarial schema.
TRACKED, UPDATED, DELETED = 70, 20, 15
CHURN_UPDATED, CHURN_DELETED = 30, 20
PLANS = ("free", "pro", "team")
STATUSES = ("active", "archived", "flagged", "deleted")
KINDS = ("create", "view", "edit")
ACTIONS = ("login", "delete", "update")
TOKEN_BYTES = 33


def percent(id_col: Column, salt: str) -> Column:
    """Uniform 0..99 from an id, reproducible in any engine with MD5."""
    digest = F.md5(F.concat(F.lit(salt + ":"), id_col.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(100))


def choice(values: Sequence[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def payload(id_col: Column, chunks: int, seed: str) -> Column:
    """High-entropy text: ``chunks`` distinct MD5 tokens joined by blanks."""
    prefix = F.concat(F.lit(seed + ":"), id_col.cast("string"), F.lit(":"))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(chunks)), lambda i: F.md5(F.concat(prefix, i.cast("string")))), " ")


def seed_rows(ids: DataFrame, id_col: str, payload_bytes: int, seed: str = "seed") -> DataFrame:
    """(id, title, language, visibility, content) with a payload of the given size."""
    chunks = max(1, payload_bytes // TOKEN_BYTES)
    c = F.col(id_col)
    return ids.select(
        c.alias("id"),
        F.concat(F.lit("seed "), c.cast("string")).alias("title"),
        F.lit("text").alias("language"),
        F.lit("public").alias("visibility"),
        payload(c, chunks, seed).alias("content"),
    )


def identity_rows(ids: DataFrame, id_col: str, every: int = 10) -> DataFrame:
    """Rows of the table with an identity key: a tenth of the seed, numbered by the load itself."""
    c = F.col(id_col)
    return ids.filter(F.pmod(c, F.lit(every)) == 0).select(
        F.floor(c / every).cast("bigint").alias("id"), F.concat(F.lit("item "), c.cast("string")).alias("title")
    )


def seed_to_size(
    spark: SparkSession, path: str, target_bytes: int, payload_bytes: int, probe_rows: int = 10_000
) -> int:
    """Write seed rows until about ``target_bytes`` lie on disk; returns the row count.

    One small batch tells the bytes per row; one write of 80 % follows, then the rest.
    """
    hadoop = spark._jsc.hadoopConfiguration()
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)

    def size() -> int:
        fs = jpath.getFileSystem(hadoop)
        return fs.getContentSummary(jpath).getLength() if fs.exists(jpath) else 0

    def batch(start: int, end: int) -> None:
        seed_rows(spark.range(start, end), "id", payload_bytes).write.mode("append").parquet(path)

    rows = min(probe_rows, max(1, target_bytes // payload_bytes))
    batch(0, rows)
    for share in (0.8, 1.0):
        per_row = max(1.0, size() / rows)
        more = int((target_bytes * share - size()) / per_row)
        if more > 0:
            batch(rows, rows + more)
            rows += more
    return rows


def users(ids: DataFrame, id_col: str) -> DataFrame:
    """Parents: null name every 7th, unicode, JSON, array and eight-digit decimals."""
    g = F.col(id_col)
    return ids.select(
        g.alias("n"),
        F.concat(F.lit("user"), g.cast("string"), F.lit("@example.com")).alias("email"),
        F.when(F.pmod(g, F.lit(7)) != 0, F.concat(F.lit("Üsér "), g.cast("string"), F.lit(" λ"))).alias("display_name"),
        F.to_json(F.struct(choice(PLANS, g).alias("plan"), g.alias("seq"))).alias("metadata"),
        F.array(
            F.concat(F.lit("t"), F.pmod(g, F.lit(5)).cast("string")),
            F.concat(F.lit("t"), F.pmod(g, F.lit(11)).cast("string")),
        ).alias("tags"),
        (g.cast("decimal(12,0)") * F.lit("1.23456789").cast("decimal(9,8)")).cast("decimal(20,8)").alias("balance"),
    )


def documents(ids: DataFrame, id_col: str, owners: int) -> DataFrame:
    """Children: derived search column, binary, nulls every 9th and 5th, interval and address."""
    g = F.col(id_col)
    number = lambda c: c.cast("string")
    content = F.concat(
        F.left(F.repeat(F.md5(F.concat(F.lit("doc:"), number(g))), F.lit(10)), F.lit(300)), F.lit(" 日本語 "), number(g)
    )
    octet = F.pmod(g, F.lit(256))
    return ids.select(
        g.alias("id"),
        (F.pmod(g, F.lit(owners)) + 1).alias("owner"),
        F.when(F.pmod(g, F.lit(9)) != 0, F.concat(F.lit("title "), number(g))).alias("title"),
        content.alias("content"),
        tokens(content).alias("search_vector"),
        F.unhex(F.md5(number(g))).alias("blob"),
        choice(STATUSES, g).alias("status"),
        F.pmod(g, F.lit(1000)).alias("views"),
        F.when(F.pmod(g, F.lit(5)) != 0, percent(g, "ratio").cast("double") / 100).alias("ratio"),
        F.concat(number(F.pmod(g, F.lit(48))), F.lit(" hours")).alias("ttl"),
        F.concat_ws(
            ".", F.lit("10"), number(octet), number(F.pmod(F.floor(g / 256), F.lit(256))), number(octet)
        ).alias("ip"),
    ).withMetadata("search_vector", {"generated": True})


def document_events(ids: DataFrame, id_col: str) -> DataFrame:
    g = F.col(id_col)
    return ids.select(
        g.alias("document_id"),
        F.lit(1).alias("seq"),
        choice(KINDS, g).alias("kind"),
        F.to_json(F.struct(g.alias("g"), (F.pmod(g, F.lit(2)) == 0).alias("ok"))).alias("data"),
    )


def audit(ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of a table without a key; null detail every 3rd."""
    g = F.col(id_col)
    return ids.select(
        F.md5(F.concat(F.lit("actor:"), g.cast("string"))).alias("actor"),
        choice(ACTIONS, g).alias("action"),
        F.when(F.pmod(g, F.lit(3)) != 0, F.concat(F.lit("detail "), g.cast("string"))).alias("detail"),
    )


def mixed_changes(ids: DataFrame, id_col: str) -> DataFrame:
    """Change rows of a write load: every id is inserted, some are updated or deleted later.

    Tracked ids enter the ledger and are never deleted. Positions order the steps of one id
    and grow with the id.
    """
    g = F.col(id_col)
    tracked = percent(g, "track") < TRACKED
    step = lambda i, op, title: F.struct(
        (g * 3 + i).alias("pos"), F.lit(op).alias("op"), F.lit(title).cast("string").alias("title")
    )
    steps = F.array_compact(
        F.array(
            step(0, "c", None),
            F.when(percent(g, "update") < UPDATED, step(1, "u", "edited")),
            F.when(~tracked & (percent(g, "delete") < DELETED), step(2, "d", None)),
        )
    )
    return ids.select(
        g.alias("id"),
        tracked.alias("tracked"),
        F.md5(F.concat(F.lit("content:"), g.cast("string"))).alias("content"),
        F.inline(steps),
    )


def churn(ids: DataFrame, id_col: str) -> DataFrame:
    """Whole-row changes (before, after) of a table without a key."""
    g = F.col(id_col)

    def image(action: str) -> Column:
        return F.struct(
            F.md5(F.concat(F.lit("actor:"), g.cast("string"))).alias("actor"),
            F.lit(action).alias("action"),
            F.concat(F.lit("d-"), g.cast("string")).alias("detail"),
        )

    fresh, edited = image("churn"), image("edited")
    none = F.when(F.lit(False), fresh)
    was_edited = percent(g, "churn-update") < CHURN_UPDATED
    step = lambda i, op, before, after: F.struct(
        (g * 3 + i).alias("pos"), F.lit(op).alias("op"), before.alias("before"), after.alias("after")
    )
    steps = F.array_compact(
        F.array(
            step(0, "c", none, fresh),
            F.when(was_edited, step(1, "u", fresh, edited)),
            F.when(
                percent(g, "churn-delete") < CHURN_DELETED,
                step(2, "d", F.when(was_edited, edited).otherwise(fresh), none),
            ),
        )
    )
    return ids.select(F.inline(steps))
