"""Quality rules whose cutoffs are certified on labelled documents.

Every rule compares one measure with a cutoff. Per stratum (a band of text length) and rule, cutoffs are tried from the most
lenient to the strictest; a cutoff is certified while an exact binomial test shows that it rejects less than a given share
of good documents. The first failure ends the sequence, which keeps the error rate of one sequence; over rules and
strata it is divided (Bonferroni). The share is divided over the rules too, so that all rules of a stratum together stay
below it. Of the certified cutoffs the one that pays most is used, or none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.llm.common import SPACE, flat, map_arrow, mix, numbered, saved, shingles3, slices, utf8, word_hashes

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


@dataclass(frozen=True)
class Rule:
    """Reject where ``sign * measure > cutoff``; cutoffs go from lenient to strict, so they fall."""

    name: str
    measure: str
    sign: int
    cutoffs: tuple[float, ...]


_SHARES = tuple(1 - k / 64 for k in range(1, 64))
RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", 1, _SHARES),
    Rule("repeated words", "n_repeat_words / greatest(n_words, 1)", 1, _SHARES),
    Rule("repeated lines", "n_dup_lines / greatest(n_lines, 1)", 1, _SHARES),
    Rule("capitals", "n_upper / greatest(word_chars, 1)", 1, _SHARES),
    Rule("long words", "word_chars / greatest(n_words, 1)", 1, tuple(30 - k / 2 for k in range(52))),
    Rule("short words", "word_chars / greatest(n_words, 1)", -1, tuple(-k / 8 for k in range(8, 40))),
)
#: Upper bounds of the bands of n_words.
BANDS = (200, 500)


def stats(texts: list[bytes]) -> np.ndarray:
    """Rows of STATS for texts given as UTF-8."""
    out = np.zeros((len(texts), 7), np.int64)
    for i, j in slices(texts):
        data, at = flat(texts[i:j])
        h, s, _ = word_hashes(data, at, lower=False)
        words = np.searchsorted(s, at)
        out[i:j, 0] = np.diff(words)
        for column, flags in ((1, ~SPACE[data] & ((data & 0xC0) != 0x80)), (2, _SYMBOL[data]), (6, _UPPER[data])):
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum(flags, out=total[1:])
            out[i:j, column] = np.diff(total[at])
        if len(h) >= 3:
            text = np.repeat(np.arange(j - i), np.diff(words))
            inside = np.flatnonzero(text[:-2] == text[2:])
            key = mix(shingles3(h)[inside] + text[inside].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            hit = np.zeros(len(h), bool)
            for k in range(3):
                hit[inside[twice] + k] = True
            total = np.zeros(len(h) + 1, np.int64)
            np.cumsum(hit, out=total[1:])
            out[i:j, 4] = np.diff(total[words])
    for i, t in enumerate(texts):
        lines = [line for line in t.split(b"\n") if line and not line.isspace()]
        out[i, 3], out[i, 5] = len(lines) - len(set(lines)), len(lines)
    return out


NAMES = [c.split()[0] for c in STATS.split(", ")]


def text_stats(docs: DataFrame, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The columns ``keep`` (doc_id) and STATS of every whole text; a null or empty one has zeros."""
    keep = keep or ["doc_id"]
    names = [*keep, *(prefix + c for c in NAMES)]
    rows = docs.select(*keep, *([] if "text" in keep else [F.col("text").cast("string").alias("text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = stats(utf8(batch.column("text").cast(pa.string())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c) for c in found.T)], names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return map_arrow(rows, run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{prefix}{c}` long" for c in NAMES)]))


def stratum(bands: tuple[int, ...] = BANDS) -> Column:
    out = F.lit(len(bands))
    for i, most in reversed(list(enumerate(bands))):
        out = F.when(F.col("n_words") < most, i).otherwise(out)
    return out


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials, exactly summed in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certified(good: np.ndarray, share: float, level: float) -> int:
    """How many cutoffs in sequence are certified. ``good[i]``: good documents that cutoff i is the first to reject;
    the last entry: those that none rejects."""
    n, rejected = int(good.sum()), np.cumsum(good[:-1])
    for i, k in enumerate(rejected):
        if n == 0 or k > share * n or binomial_tail(int(k), n, share) > level:
            return i
    return len(rejected)


def choose(counts: dict[tuple[int, int], np.ndarray], rules: tuple[Rule, ...], strata: int, share: float, error: float, price: float) -> dict[tuple[int, int], float]:
    """Cutoff per (stratum, rule). ``counts``: two rows (bad, good) of first-rejection counts."""
    out = {}
    for (s, r), (bad, good) in counts.items():
        n = certified(good, share / len(rules), error / (len(rules) * strata))
        gain = np.cumsum(bad[:n]) - price * np.cumsum(good[:n])
        if n and gain.max() > 0:
            out[s, r] = rules[r].cutoffs[int(np.argmax(gain))]
    return out


def find_cutoffs(found: DataFrame, labels: DataFrame, rules: tuple[Rule, ...], bands: tuple[int, ...], share: float, error: float, price: float) -> dict[tuple[int, int], float]:
    """Cutoffs from all labelled documents; rows with a null label are left out, repeated ones count each time."""
    marked = found.join(labels.filter("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")

    def first_to_reject(rule: Rule) -> Column:
        value = F.lit(rule.sign) * F.expr(rule.measure)
        return F.size(F.filter(F.array(*map(F.lit, rule.cutoffs)), lambda c: ~(value > c)))

    first = F.array(*map(first_to_reject, rules))
    rows = marked.select("quality", stratum(bands).alias("stratum"), F.posexplode(first).alias("rule", "first"))
    counts: dict[tuple[int, int], np.ndarray] = {}
    for q, s, r, f, n in rows.groupBy("quality", "stratum", "rule", "first").count().collect():  # at most strata x cutoffs x 2
        if q in (0, 1):
            counts.setdefault((s, r), np.zeros((2, len(rules[r].cutoffs) + 1), np.int64))[q, f] += n
    return choose(counts, rules, len(bands) + 1, share, error, price)


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    bands: tuple[int, ...] = BANDS,
    share: float = 0.05,
    error: float = 0.05,
    price: float = 20.0,
) -> DataFrame:
    """doc_id, STATS, base_failed, rule (the first that rejects) and kept of every row.

    ``share``: good documents that a stratum may lose at most, with probability 1 - ``error`` over all strata. ``price``:
    bad documents that must go for each good one lost. Without labels nothing but the base rejects.
    """
    found = saved(text_stats(docs), "text-stats")
    return verdict(found, find_cutoffs(found, labels, rules, bands, share, error, price), rules, bands)


def verdict(found: DataFrame, cutoffs: dict[tuple[int, int], float], rules: tuple[Rule, ...] = RULES, bands: tuple[int, ...] = BANDS) -> DataFrame:
    """Add base_failed, rule and kept to rows with STATS."""
    reason = F.lit(None).cast("string")
    for (s, r), cut in sorted(cutoffs.items(), reverse=True):
        reason = F.when((stratum(bands) == s) & (F.lit(rules[r].sign) * F.expr(rules[r].measure) > cut), rules[r].name).otherwise(reason)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumns({"base_failed": failed, "rule": reason}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, share: float = 0.05, error: float = 0.05, price: float = 20.0) -> DataFrame:
    """The rows that no rule rejects, with all their columns, whatever these are called."""
    plain, own = numbered(docs)
    measured = text_stats(plain, plain.columns, "_llm_")
    found = saved(measured.select("doc_id", *(F.col(f"_llm_{c}").alias(c) for c in NAMES)), "text-stats")
    cutoffs = find_cutoffs(found, labels, RULES, BANDS, share, error, price)
    packed = measured.select(F.struct(*own).alias("_llm_row"), *(F.col(f"_llm_{c}").alias(c) for c in NAMES))
    return verdict(packed, cutoffs).filter("kept").select("_llm_row.*")
