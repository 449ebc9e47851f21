"""Benchmark decontamination as a prefix-filtered join of word windows.

A window of a benchmark item is contained in a document only if its rarest shingle (two neighbouring words) is, so that one
is its necessary prefix; rarity is counted over all documents. A document is probed shingle by shingle; a hit at position i
of a shingle that lies j words into a window can only be a window from i - j on. That must lie inside the document (the bounds by
length and position), and then all its words are compared.

The benchmark is the stated query set. It is taken in blocks of bounded size, each against all documents; a document's hits so far
travel with it from block to block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.common import flat, map_arrow, mix, numbered, slices, utf8, word_hashes

#: Benchmark text that one block holds at most, but for a longer single item.
BLOCK_BYTES = 16 << 20

# Words are runs of a-z, 0-9 and characters beyond ASCII; A-Z count as a-z.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_U = np.uint64


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and where each text's words begin (one more entry for the end)."""
    data, at = flat([t.translate(_TO_WORDS) for t in texts])
    h, s, _ = word_hashes(data, at, lower=False)
    return h, np.searchsorted(s, at)


def pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * _U(3) + h[1:])


@dataclass
class Index:
    """Windows of one benchmark block. Windows of equal words are one; ``items`` lists the items of each."""

    words: list[np.ndarray]  # distinct windows' word hashes
    items: list[list[str]]
    shingles: np.ndarray  # sorted distinct shingle hashes of all windows; of a one-word window, the word
    prefix: np.ndarray | None = None  # sorted shingle hash per (window, offset) entry
    window: np.ndarray | None = None
    offset: np.ndarray | None = None

    def choose(self, seen: np.ndarray) -> "Index":
        """Take each window's rarest shingle as its prefix; ``seen`` counts the shingles over all documents."""
        key, offset = np.zeros(len(self.words), _U), np.zeros(len(self.words), np.int64)
        for w, h in enumerate(self.words):
            s = pairs(h) if len(h) > 1 else h
            j = int(np.argmin(seen[np.searchsorted(self.shingles, s)]))
            key[w], offset[w] = s[j], j
        order = np.argsort(key, kind="stable")
        return Index(self.words, self.items, self.shingles, key[order], order, offset[order])


def build(rows: list[tuple[object, str | None]], window: int) -> Index:
    """Windows of the items; an item of fewer words, but not none, is one window."""
    h, at = words_of([(t or "").encode() for _, t in rows])
    found: dict[bytes, set[str]] = {}
    for (item, _), a, b in zip(rows, at, at[1:]):
        own = h[a:b]
        for i in range(max(1, len(own) - window + 1) if len(own) else 0):
            found.setdefault(own[i : i + window].tobytes(), set()).add(str(item))
    words = [np.frombuffer(k, _U) for k in found]
    every = [pairs(w) if len(w) > 1 else w for w in words]
    return Index(words, [sorted(v) for v in found.values()], np.unique(np.concatenate(every)) if every else np.zeros(0, _U))


class Probe:
    """Looks positions of shingles up: a bit table first, then the sorted keys."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(10, math.ceil(math.log2(len(keys) + 1)) + 5)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[keys >> _U(64 - self.bits)] = True

    def find(self, shingles: np.ndarray) -> np.ndarray:
        """Positions of shingles that are keys."""
        at = np.flatnonzero(self.table[shingles >> _U(64 - self.bits)])
        if not len(at) or not len(self.keys):
            return at[:0]
        k = np.searchsorted(self.keys, shingles[at])
        k[k == len(self.keys)] = 0
        return at[self.keys[k] == shingles[at]]


def occurrences(h: np.ndarray, begin: np.ndarray, index: Index, probe: Probe) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word (in ``h``) and window of every occurrence in the documents that begin at ``begin``."""
    out = []
    for singles in (False, True):
        shingle = h if singles else pairs(h) if len(h) > 1 else h[:0]
        at = probe.find(shingle)
        if not len(at):
            continue
        low, high = np.searchsorted(index.prefix, shingle[at]), np.searchsorted(index.prefix, shingle[at], "right")
        n = high - low
        entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        window = index.window[entry]
        size = np.array([len(w) for w in index.words], np.int64)[window]
        first = at - index.offset[entry]
        doc = np.searchsorted(begin, at, "right") - 1
        ok = ((size == 1) == singles) & (first >= begin[doc]) & (first + size <= begin[doc + 1])
        for length in np.unique(size[ok]):
            c = np.flatnonzero(ok & (size == length))
            same = np.ones(len(c), bool)
            want = np.zeros((len(index.words), int(length)), _U)
            for w in np.unique(window[c]):
                want[w] = index.words[w]
            for k in range(int(length)):
                same &= h[first[c] + k] == want[window[c], k]
            out.append((doc[c[same]], first[c[same]], window[c[same]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _merge(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint spans (rows of begin, end) with the same words."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], 1)


def _scan(docs: DataFrame, index: Index, last: bool, keep: list[str], passed: list[str]) -> DataFrame:
    """Add one block's hits to the columns ``_spans`` (pairs of longs) and ``_items``; at the last block count words as well.
    ``passed``: ``_text``, if a later step needs it."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # BLOCK_BYTES bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        probe = Probe(own.prefix)
        for batch in batches:
            texts = utf8(batch.column("_text"))
            spans, items, counts = batch.column("_spans").to_pylist(), batch.column("_items").to_pylist(), []
            for i, j in slices(texts):
                h, begin = words_of(texts[i:j])
                counts += np.diff(begin).tolist()
                doc, first, window = occurrences(h, begin, own, probe)
                order = np.argsort(doc, kind="stable")
                doc, first, window = doc[order], first[order], window[order]
                cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else []
                for a, b in zip(cuts, [*cuts[1:], len(doc)]):
                    d = int(doc[a])
                    size = np.array([len(own.words[w]) for w in window[a:b]])
                    new = np.stack([first[a:b] - begin[d], first[a:b] - begin[d] + size], 1)
                    old = np.frombuffer(spans[i + d] or b"", "<i8").reshape(-1, 2)
                    spans[i + d] = _merge(np.concatenate([old, new])).astype("<i8").tobytes()
                    items[i + d] = sorted({*(items[i + d] or []), *(x for w in set(window[a:b].tolist()) for x in own.items[w])})
            out = {c: batch.column(c) for c in [*keep, *passed]} | ({"_n_words": pa.array(counts, pa.int64())} if last else {})
            out |= {"_spans": pa.array(spans, pa.binary()), "_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    own = [f"`{c}` {kinds[c]}" for c in [*keep, *passed]] + ["_n_words long"] * last
    return map_arrow(docs.select(*keep, "_text", "_spans", "_items"), run, ", ".join([*own, "_spans binary", "_items array<string>"]))


def _rarity(docs: DataFrame, index: Index) -> np.ndarray:
    """How often each of the block's shingles occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(index.shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        probe, seen = Probe(keys), np.zeros(len(keys), np.int64)
        for batch in batches:
            texts = utf8(batch.column(0))
            for i, j in slices(texts):
                h, begin = words_of(texts[i:j])
                for shingle in (h, pairs(h) if len(h) > 1 else h[:0]):
                    seen += np.bincount(np.searchsorted(keys, shingle[probe.find(shingle)]), minlength=len(keys))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["shingle", "n"])

    out = np.zeros(len(index.shingles), np.int64)
    counted = map_arrow(docs.select("_text"), run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    for s, n in counted.collect():  # at most one row per shingle of the block
        out[s] = n
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_too: bool = False) -> DataFrame:
    """doc_id, ``_n_words``, ``_spans`` (hit words, begin and end) and ``_items`` (text of item_ids) of every document; with ``text_too`` all
    its columns.

    Null or empty texts have no words; an item without words or without id has no window; repeated items count once, by id.
    """
    others = [c for c in docs.columns if c != "text"] if text_too else ["doc_id"]
    benchmark = benchmark.select("item_id", "text").dropDuplicates()
    size = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    rows = docs.select(*others, F.col("text").cast("string").alias("_text"), F.lit(None).cast("binary").alias("_spans"), F.lit(None).cast("array<string>").alias("_items"))
    out = rows
    for k in range(blocks):
        items = benchmark.filter(block == k).select(F.col("item_id").cast("string"), F.col("text").cast("string")).collect()
        index = build([tuple(r) for r in items if r[0] is not None], window)
        last = k == blocks - 1
        out = _scan(out, index.choose(_rarity(rows, index)), last, others, ["_text"] if text_too or not last else [])
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows without any benchmark window, with all their columns, whatever these are called."""
    plain, own = numbered(docs)
    clean = find_contamination(plain, benchmark, window, text_too=True).filter("_spans IS NULL")
    return clean.withColumnRenamed("_text", "text").select(*own)


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; the digest of no items is that of no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [np.frombuffer(s or b"", "<i8").reshape(-1, 2) for s in batch.column("_spans").to_pylist()]
            items = [sorted(x or []) for x in batch.column("_items").to_pylist()]
            hit = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
            columns = [
                batch.column("doc_id"),
                batch.column("_n_words"),
                pa.array(hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                pa.array([n > 0 for n in hit]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return map_arrow(found.select("doc_id", "_n_words", "_spans", "_items"), run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
