"""URL verdicts: longest matching rule, else logistic regression on hashed character n-grams of host and path.

Features and scores are DataFrame expressions, in training and in use. The small labelled table's feature rows come to the
driver, where plain gradient descent finds the weights; they enter the plan as one array literal of fixed length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path prefix, verdict). A rule fits its host and all subdomains.
Rule = tuple[str, str, str]

# Words of hosts that a crawl for text should skip, and of hosts that it should keep: the labelled table is their
# product with a few shapes of address.
BLOCKED = (
    "casino-win free-bets cheap-pills ads-track adult-cams xxx-video poker-room slots-bonus porn-tube viagra-shop pills-store "
    "betting-odds free-casino win-jackpot track-pixel ad-server click-ads popup-ads loan-fast payday-cash sex-chat hot-cams "
    "adult-video adult-site spam-links spam-host link-farm x-rated crack-keygen warez-free torrent-crack replica-watch fake-id spam-mail malware-host phish-login"
).split()
ALLOWED = (
    "library museum journal theatre weather recipes gardens history science physics chemistry biology cooking travel letters "
    "poetry gazette herald tribune archive lecture college another nation station attention ocean earth northern southern "
    "that there other than then weather hat thatch motion onset reason thread shell want range thesis notion shore heron throne tether anthem lantern rhythm orient notes docs wiki forum research hospital council "
    "parish railway harbour mountain river forest village kitchen workshop orchestra gallery observatory"
).split()
SHAPES = (("", "/en/{n}"), ("www.", "/{n}.html"), ("m.", "/de/{n}/"), ("blog.", "/fr/{n}"))
TOPS = ("example.com", "example.net", "example.org", "com", "net")


def labelled_urls() -> list[tuple[str, str, float]]:
    """The labelled table: host, path, 1 for block; a few hundred rows made by a rule from the words above."""
    rows = []
    for label, words in ((1.0, BLOCKED), (0.0, ALLOWED)):
        for i, word in enumerate(words):
            for j, (before, path) in enumerate(SHAPES):
                rows.append((f"{before}{word}.{TOPS[(i + j) % len(TOPS)]}", path.format(n=37 * i + 1009 * j + 5), label))
    return rows


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path. Null, or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_verdict(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does. Of equally long ones the last in text order."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def buckets(host: Column, path: Column, sizes: tuple[int, ...], width: int) -> Column:
    """Hash buckets of the character n-grams of ``<host>`` and of the path; repeats stay."""

    def grams(text: Column, n: int, salt: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(salt), text.substr(i, F.lit(n))), F.lit(width)).cast("int"))

    marked = (F.concat(F.lit("<"), host, F.lit(">")), F.concat(path, F.lit(">")))
    return F.concat(*[grams(text, n, salt) for salt, text in enumerate(marked) for n in sizes])


def train(labelled: DataFrame, sizes: tuple[int, ...], width: int, steps: int, rate: float, decay: float) -> list[float]:
    """Weights (the last is the bias) by full gradient descent.

    A text's features are its buckets' shares. An empty table gives zero weights.
    """
    x = buckets(F.col("host"), F.col("path"), sizes, width)
    rows = labelled.select("label", x.alias("x")).collect()  # the small labelled table, by contract
    weights = [0.0] * (width + 1)
    if not rows:
        return weights
    sparse = []
    for r in rows:
        share: dict[int, float] = {width: 1.0}
        for b in r["x"]:
            share[b] = share.get(b, 0.0) + 1.0 / math.sqrt(len(r["x"]))
        sparse.append((r["label"], share))
    for _ in range(steps):
        gradient: dict[int, float] = {}
        for label, share in sparse:
            z = sum(weights[b] * v for b, v in share.items())
            miss = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))) - label
            for b, v in share.items():
                gradient[b] = gradient.get(b, 0.0) + miss * v
        for b, g in gradient.items():
            weights[b] -= rate * (g / len(sparse) + (decay * weights[b] if b < width else 0.0))
    return weights


def logit(x: Column, weights: list[float]) -> Column:
    """Score of a bucket array: shares times weights, plus the bias."""
    table = F.expr("array(" + ", ".join(f"{w!r}D" for w in weights[:-1]) + ")")
    total = F.aggregate(x, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return total / F.sqrt(F.size(x).cast("double")) + F.lit(weights[-1])


def filter_urls(pages: DataFrame, rules: list[Rule], labelled: DataFrame, sizes: tuple[int, ...] = (3, 4), width: int = 8192, steps: int = 300, rate: float = 20.0, decay: float = 1e-4) -> DataFrame:
    """page_id, host, path, rule and verdict of every row, by rule or else by the model (block at odds of one or more).

    An empty host is allowed unless a rule says otherwise.
    """
    weights = train(labelled, sizes, width, steps, rate, decay)
    host, path = split_url(F.col("url").cast("string"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    text, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    score = logit(buckets(F.col("host"), F.col("path"), sizes, width), weights)
    model = F.when((F.col("host") != "") & (score >= 0), "block").otherwise("allow")
    return parts.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, model).alias("verdict"))


def labelled_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', {y}D)" for h, p, y in labelled_urls())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, label)")
