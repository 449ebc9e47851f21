"""Divergence of sources within each language: which terms a source overuses, and how far apart two sources are.

Terms are counted in tasks and summed by Spark. Term shares are exact integers. The terms that a group overuses most come
from a dominance skyband: a term that fewer than k others dominate (more often in the group, more rarely in the language,
earlier in UTF-8) may be among the first k, every other one can't be. Tasks keep the skyband of their rows, the skybands
are merged, and only what is left gets ranked.

The distance of two sources sums over all kept terms, also those that one or both lack. An absent term has its group's base
share, so a task adds only what present terms change, and the rest is one product: kept terms times the difference of bases.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinproof.llm.common import map_arrow, saved, utf8

#: Bytes that end a term become spaces, A-Z become a-z; all bytes of characters from U+0080 on belong to terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE, PRIOR = 1_000_000_000, 5


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, in order."""
    return text.translate(_FOLD).split()


def term_counts(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and the documents that hold it. Nulls are ''.

    A task adds up at most about ``most`` terms before it passes them on; Spark sums the rest.
    """

    def rows(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, has) in counts.items():
            terms = list(n)
            columns = [
                pa.array([lang] * len(terms), pa.string()),
                pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array(list(n.values()), pa.int64()),
                pa.array([has[t] for t in terms], pa.int64()),
            ]
            yield from pa.Table.from_arrays(columns, ["lang", "source", "term", "n", "docs"]).to_batches(20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                n, has = counts.get((lang, source)) or counts.setdefault((lang, source), (Counter(), Counter()))
                terms = terms_of(text)
                held -= len(n)
                n.update(terms)
                has.update(set(terms))
                held += len(n)
                if held > most:
                    yield from rows(counts)
                    counts, held = {}, 0
        yield from rows(counts)

    words = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = map_arrow(words, run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: F.Column | str, total: F.Column, kept: F.Column) -> F.Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), exact for any counts."""
    count = F.col(count) if isinstance(count, str) else count
    top = (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (total + PRIOR * kept).cast("decimal(20,0)")) + 1


def skyband(count: np.ndarray, total: np.ndarray, term: np.ndarray, k: int) -> np.ndarray:
    """Indices of the rows that fewer than ``k`` others dominate: count not lower, total not higher, term earlier.

    Terms differ from each other. A row's first k dominators in this order are in the skyband themselves, so it is enough to
    look at the rows kept so far.
    """
    order = np.lexsort((term, total, -count))
    place = np.empty(len(term), np.int64)
    place[np.argsort(term, kind="stable")] = np.arange(len(term))
    kept_total, kept_place, kept = np.empty(len(order), np.int64), np.empty(len(order), np.int64), []
    for i in order:
        m = len(kept)
        if m >= k and np.count_nonzero((kept_total[:m] <= total[i]) & (kept_place[:m] < place[i])) >= k:
            continue
        kept_total[m], kept_place[m] = total[i], place[i]
        kept.append(i)
    return np.asarray(kept, np.int64)


def skybands(rows: DataFrame, k: int, most: int = 20_000) -> DataFrame:
    """Each task's skyband of every (lang, source) in ``rows`` (lang, source, term, n, total, value)."""

    def reduced(held: dict) -> int:
        for key, parts in held.items():
            n, total, term, value = (np.concatenate(x) for x in zip(*parts))
            at = skyband(n, total, term, k)
            held[key] = [(n[at], total[at], term[at], value[at])]
        return sum(len(p[0][0]) for p in held.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}
        size, limit = 0, most
        for batch in batches:
            if not len(batch):
                continue
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            term = np.array(utf8(batch.column(2)), object)
            n, total, value = (batch.column(c).to_numpy() for c in (3, 4, 5))
            where: dict[tuple[str, str], list[int]] = {}
            for i, g in enumerate(groups):
                where.setdefault(g, []).append(i)
            for g, at in where.items():
                held.setdefault(g, []).append((n[at], total[at], term[at], value[at]))
            size += len(batch)
            if size > limit:
                size = reduced(held)
                limit = max(most, 2 * size)
        reduced(held)
        for (lang, source), [(n, total, term, value)] in held.items():
            same = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
            texts = pa.array(term.tolist(), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*same, texts, pa.array(n), pa.array(total), pa.array(value)], ["lang", "source", "term", "n", "total", "value"])

    return map_arrow(rows, run, "lang string, source string, term string, n long, total long, value long")


def changes(terms: DataFrame, bases: dict[str, np.ndarray], cells: int = 1 << 20) -> DataFrame:
    """(lang, a, b, change): sum over terms of |p_a - p_b| less the difference of the two bases.

    ``terms``: lang and, for a term, the groups' numbers within the language and their shares. ``bases``: the shares of absent
    terms by number. A task holds ``cells`` shares of terms at a time, and one number for each pair in its languages.
    """

    def add(out: np.ndarray, base: np.ndarray, at: list[np.ndarray], p: list[np.ndarray]) -> None:
        shares = np.tile(base, (len(at), 1))
        present = np.zeros(shares.shape, bool)
        row = np.repeat(np.arange(len(at)), [len(x) for x in at])
        column = np.concatenate(at)
        shares[row, column], present[row, column] = np.concatenate(p), True
        for a in np.unique(column):
            mine = present[:, a]
            change = np.abs(shares[mine, a][:, None] - shares[mine]) - np.abs(base[a] - base)
            out[a] += change.sum(0)
            change[present[mine]] = 0
            out[:, a] += change.sum(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            where: dict[str, list[int]] = {}
            for i, lang in enumerate(batch.column(0).to_pylist()):
                where.setdefault(lang, []).append(i)
            at, p = ([np.asarray(x, np.int64) for x in batch.column(c).to_pylist()] for c in (1, 2))
            for lang, rows in where.items():
                base = bases[lang]
                out = sums.setdefault(lang, np.zeros((len(base), len(base)), np.int64))
                step = max(1, cells // len(base))
                for i in range(0, len(rows), step):
                    part = rows[i : i + step]
                    add(out, base, [at[j] for j in part], [p[j] for j in part])
        for lang, out in sums.items():
            a, b = np.nonzero(out)
            yield from pa.Table.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(out[a, b])], ["lang", "a", "b", "change"]).to_batches(50_000)

    return map_arrow(terms, run, "lang string, a int, b int, change long")


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group in ``docs`` (text, lang, source).

    Part ``pair``: the distance to each other source of the language, all of them. Part ``term``: the ``top`` terms whose share is
    above the language's. Ranks start from 1, larger values first, then earlier UTF-8. A language keeps the terms in at least
    ``min_docs`` of its documents; repeated rows count each time. A language without kept terms has distances of 0 and no
    terms; an empty table gives no rows. Null text, lang and source are ''. Other columns are not read.

    The groups' names and base shares go through the driver: one row a group, far fewer than the pairs returned.
    """
    terms = saved(term_counts(docs), "terms")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")
    entries = saved(terms.drop("docs").join(kept, ["lang", "term"]), "kept-terms")
    langs = entries.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_sum"))
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("own_sum"))
    names = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    zero = {"kept": 0, "lang_sum": 0, "own_sum": 0}
    groups = names.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(zero)
    groups = groups.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    base = F.when(F.col("kept") > 0, share(F.lit(0), F.col("own_sum"), F.col("kept"))).otherwise(0)
    groups = saved(groups.withColumn("base", base.cast("long")), "groups")

    shares = entries.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "total", "nth",
        share("n", F.col("own_sum"), F.col("kept")).alias("p"),
        share("total", F.col("lang_sum"), F.col("kept")).alias("q"),
    )
    shares = saved(shares, "shares")
    over = shares.filter("p > q").select("lang", "source", "term", "n", "total", (F.col("p") - F.col("q")).alias("value"))
    merged = skybands(skybands(over, top).repartition("lang", "source"), top)
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    named = merged.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    named = named.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)

    bases: dict[str, list[int]] = {}
    for r in groups.orderBy("lang", "nth").select("lang", "base").toLocalIterator():
        bases.setdefault(r.lang, []).append(r.base)
    lists = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("nth", "p")).alias("own"))
    moved = changes(lists.select("lang", "own.nth", "own.p"), {k: np.asarray(v, np.int64) for k, v in bases.items()})
    moved = moved.groupBy("lang", "a", "b").agg(F.sum("change").alias("change"))
    one = groups.select("lang", "source", "kept", F.col("nth").alias("a"), F.col("base").alias("base_a"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("nth").alias("b"), F.col("base").alias("base_b"))
    both = one.join(other, "lang").filter("a <> b").join(moved, ["lang", "a", "b"], "left")
    value = F.col("kept") * F.abs(F.col("base_a") - F.col("base_b")) + F.coalesce("change", F.lit(0))
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(first))
    return pairs.unionByName(named)
