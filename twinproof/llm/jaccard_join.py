"""Exact join of documents whose three-word shingle sets have a high Jaccard similarity.

Equal sets are one record from the start. Records that can match share a shingle among the first few of a common order, rare
shingles first (the prefix filter); such a shingle's records are a bucket. Pairs are taken from buckets in three ways:

1. Stars: each record with the hub of each of its buckets, the record with the fewest uncommon shingles. In a heap of near
   copies this finds most links without comparing the copies with each other.
2. Pairs of small buckets, if the number of prefix shingles that they share does not rule them out.
3. Large buckets that still hold records of different components are joined to cells; within a cell each record is compared with
   those of other components. Large cells are split into pairs of blocks, by size class and salt, so tasks stay bounded.

A pair is dropped if the records' sketches rule it out: a sketch has the parity of a set's shingles by hash, about a bit a shingle, and two sketches
differ in no more bits than their sets have shingles that the other lacks. The T-occurrence search then reads the shingles of what is left, for hubs and their partners; pairs of 2
and 3 are searched after those of 1, of which only components are needed. What a phase writes is dealt over rounds of a bounded size, each of which deletes its files, so
disk stays in proportion to the documents however many of them are alike.

The search is DivideSkip: inverted lists of a query's shingles are divided by length; the short ones are merged in record order and
give candidates with enough occurrences, which are then looked up in the long lists by binary search.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.common import Scratch, flat, map_arrow, mix, shingles3, slices, utf8, word_hashes
from twinproof.llm.components import components

_U = np.uint64
#: Shingles whose frequency every task knows; it decides the order only, so results don't depend on it.
COMMON = 1 << 17
#: The same for words; a shingle is taken to be as rare as its rarest word.
COMMON_WORDS = 1 << 18
#: Records of a bucket whose pairs are looked at one by one.
SMALL = 32
#: Records of a cell's block.
BLOCK = 1024
#: Weight of the long lists' length in DivideSkip's choice of how many lists are long.
MU = 0.01
#: Bits of a sketch, at most.
SKETCH = 1 << 16
#: Partners of a record that a pair of blocks gives at first; with more of them the cells are compared again, for 16 times as many.
PARTNERS = 64
#: Bytes that a round may write at least, and else so many parts of all documents' shingles (of 8 bytes each).
ROUND = 64 << 20
ROUND_PARTS = 4


def least_overlap(n: int, percent: int) -> int:
    """Shingles that any match of a set of n must share with it."""
    return -(-percent * n // 100)


@dataclass
class Common:
    """Frequent hashes, sorted, and how often each was seen."""

    hashes: np.ndarray
    often: np.ndarray

    def count(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        k = np.searchsorted(self.hashes, h)
        k[k == len(self.hashes)] = 0
        return np.where(self.hashes[k] == h, self.often[k], 0)


def shingle_sets(texts: list[bytes], words: Common | None = None, seen: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes of each text, and the count of each one's rarest word; one shingle for a text of fewer than
    three words, none for no words. ``seen`` takes the word hashes."""
    for i, j in slices(texts):
        data, at = flat(texts[i:j])
        h, s, _ = word_hashes(data, at, lower=True)
        if seen is not None:
            seen.append(h)
        cut = np.searchsorted(s, at)
        three = shingles3(h) if len(h) > 2 else h[:0]
        if words is not None and len(h) > 2:
            c = words.count(h)
            rarest = np.minimum(np.minimum(c[:-2], c[1:-1]), c[2:])
        else:
            rarest = np.zeros(len(three), np.int64)
        for a, b in zip(cut, cut[1:]):
            if b - a >= 3:
                own, first = np.unique(three[a : b - 2], return_index=True) if words is not None else (np.unique(three[a : b - 2]), slice(0, 0))
                yield own, rarest[a : b - 2][first]
            elif b > a:
                yield mix(mix(h[a : a + 1] + _U(b - a)) + (h[b - 1 : b] if b - a == 2 else _U(0))), np.zeros(1, np.int64)
            else:
                yield h[:0], np.zeros(0, np.int64)


def set_id(s: np.ndarray) -> int:
    """64-bit fingerprint of a set."""
    total = np.add.reduce(mix(s ^ _U(0x8EBC6AF09C88C6E3)), dtype=_U)
    return int(mix(np.array([total + _U(len(s))], _U)).view(np.int64)[0])


# -- sketches --------------------------------------------------------------------------------------


def sketch(s: np.ndarray) -> bytes:
    """Parities of the numbers of shingles by their last bits: a bit a shingle, up to the next power of two."""
    bits = min(SKETCH, max(64, 1 << (len(s) - 1).bit_length()))
    odd = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Sketches (a row of 64-bit words each) as they would be with fewer bits."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def most_apart(n: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that only one of two matches of sizes n and n_b has, at most; negative if such sizes never match."""
    need = -(-percent * (n + n_b) // (100 + percent))
    return np.where(need <= np.minimum(n, n_b), n + n_b - 2 * need, -1)


def _words(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one length as rows of 64-bit words."""
    return np.frombuffer(b"".join(sketches), _U).reshape(len(sketches), -1)


def can_match(n: np.ndarray, n_b: np.ndarray, a: list[bytes], b: list[bytes], percent: int) -> np.ndarray:
    """Which pairs their sketches do not rule out."""
    length = np.array([(len(x), len(y)) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    out = most_apart(n, n_b, percent) >= 0
    for x, y in np.unique(length, axis=0):
        at = np.flatnonzero((length == (x, y)).all(1) & out)
        if len(at):
            words = min(x, y) // 8
            differ = folded(_words([a[i] for i in at]), words) ^ folded(_words([b[i] for i in at]), words)
            out[at] = np.bitwise_count(differ).sum(1, dtype=np.int64) <= most_apart(n[at], n_b[at], percent)
    return out


class Sketches:
    """Records of a cell by size, compared by their sketches."""

    def __init__(self, sizes: list[int], groups: list[int], asks: list[bool], sketches: list[bytes]):
        self.order = np.argsort(np.array(sizes, np.int64), kind="stable")
        self.size = np.array(sizes, np.int64)[self.order]
        self.group = np.array(groups, np.int64)[self.order]
        self.asks = np.array(asks, bool)[self.order]
        ordered = [sketches[i] for i in self.order]
        words = np.array([len(x) // 8 for x in ordered])  # never less for a larger set
        self.first = {w: int(np.searchsorted(words, w)) for w in np.unique(words).tolist()}
        #: Sketches by number of words: those of at least so many, folded. A match has half or twice as many at most, unless it is tiny.
        self.words, self.rows = words, {}
        for w, begin in self.first.items():
            parts = [(v, v_begin) for v, v_begin in self.first.items() if v >= w]
            ends = [*(x for _, x in parts[1:]), len(ordered)]
            self.rows[w] = np.concatenate([folded(_words(ordered[i:j]), w) for (_, i), j in zip(parts, ends)])

    def partners(self, q: int, percent: int) -> np.ndarray:
        """Positions of records of other groups that the sketches allow to match position q; of two that ask, the later one."""
        n, w = int(self.size[q]), int(self.words[q])
        low, high = np.searchsorted(self.size, -(-percent * n // 100)), np.searchsorted(self.size, 100 * n // percent, "right")
        found = []
        for v, begin in self.first.items():
            i = max(low, begin)
            j = high if v == w else min(high, next((x for u, x in self.first.items() if u > v), len(self.size)))
            if v > w or i >= j:  # larger sketches are compared folded, with those of q's own length
                continue
            rows = self.rows[v]
            apart = np.bitwise_count(rows[i - begin : j - begin] ^ rows[q - begin]).sum(1, dtype=np.int64)
            ok = apart <= most_apart(np.int64(n), self.size[i:j], percent)
            ok &= (self.group[i:j] != self.group[q]) & (~self.asks[i:j] | (np.arange(i, j) > q))
            found.append(i + np.flatnonzero(ok))
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def pairs(self, percent: int, most: int) -> Iterator[tuple[int, int, bool]]:
        """Pairs of record numbers, up to ``most`` for each that asks, and whether that has more."""
        for q in np.flatnonzero(self.asks):
            found = self.partners(int(q), percent)
            for r in found[:most]:
                yield int(self.order[q]), int(self.order[r]), len(found) > most


# -- search in a cell ------------------------------------------------------------------------------


class Cell:
    """Inverted lists over some records, and the links found so far as a forest."""

    def __init__(self, records: list[np.ndarray], groups: list[int]):
        """``groups``: records of one number are known to be connected."""
        self.size = np.array([len(r) for r in records], np.int64)
        self.cut = np.append(0, np.cumsum(self.size))
        tokens = np.concatenate(records) if records else np.zeros(0, _U)
        owner = np.repeat(np.arange(len(records)), self.size)
        order = np.argsort(tokens, kind="stable")
        new = np.append(True, tokens[order][1:] != tokens[order][:-1]) if len(tokens) else np.zeros(0, bool)
        self.list_of = np.empty(len(tokens), np.int64)
        self.list_of[order] = np.cumsum(new) - 1
        self.owner = owner[order]
        self.start = np.append(np.flatnonzero(new), len(tokens))
        self.length = np.diff(self.start)
        self.keys = self.list_of[order] * len(records) + self.owner
        first: dict[int, int] = {}
        self.root = np.array([first.setdefault(g, i) for i, g in enumerate(groups)], np.int64)

    def matches(self, q: int, percent: int) -> np.ndarray:
        """Records of other components that match record q."""
        n = int(self.size[q])
        lists = self.list_of[self.cut[q] : self.cut[q + 1]]
        lists = lists[np.argsort(self.length[lists], kind="stable")]
        least = least_overlap(n, percent)
        longest = int(self.length[lists[-1]])
        long = min(least - 1, math.ceil(least / (MU * math.log2(longest + 1) + 1)))
        short, probed = lists[: n - long], lists[n - long :]
        # Merge the short lists in record order; the stable sort merges their sorted runs.
        take = self.length[short]
        entry = np.repeat(self.start[short], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
        merged = np.sort(self.owner[entry], kind="stable")
        begin = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
        record, count = merged[begin], np.diff(np.append(begin, len(merged)))
        ok = (count >= least - long) & (self.root[record] != self.root[q])
        ok &= (100 * self.size[record] >= percent * n) & (percent * self.size[record] <= 100 * n)
        record, count = record[ok], count[ok]
        step = max(1, (1 << 20) // max(1, len(probed)))
        for i in range(0, len(record), step):
            want = probed[:, None] * len(self.size) + record[None, i : i + step]
            at = np.searchsorted(self.keys, want)
            at[at == len(self.keys)] = 0
            count[i : i + step] += (self.keys[at] == want).sum(0)
        return record[100 * count >= percent * (n + self.size[record] - count)]

    def search(self, queries: list[int], percent: int) -> list[tuple[int, int]]:
        """Links that join components, until no match between different ones is left for the queries.

        Queries whose lists are longest come first: where copies surround one record, it soon joins them all.
        """
        links = []
        mean = [float(self.length[self.list_of[self.cut[q] : self.cut[q + 1]]].mean()) for q in queries]
        for k in np.argsort(-np.array(mean), kind="stable"):
            q = queries[k]
            if (self.root == self.root[q]).all():
                continue
            for r in self.matches(q, percent):
                if self.root[r] != self.root[q]:
                    links.append((q, int(r)))
                    self.root[self.root == self.root[r]] = self.root[q]
        return links


def by_cell(rows: DataFrame, keys: list[str], columns: list[str], fn: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """What a function makes of each cell's records, if there are several. It gets the other columns by set_id; a record may be repeated in a cell, and asks if one of its rows does."""
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys)
    width, kinds = len(keys), [x.split() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        into = pa.schema([(name, pa.bool_() if kind == "boolean" else pa.int64()) for name, kind in kinds])

        def found() -> pa.RecordBatch:
            made = fn(held)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], f.type) for k, f in enumerate(into)], schema=into)

        for batch in batches:
            values = [batch.column(c).to_pylist() for c in range(width + 2 + len(columns))]
            for row in zip(*values):
                if row[:width] != key:
                    if len(held) > 1:
                        yield found()
                    key, held = row[:width], {}
                i, asks, *rest = row[width:]
                old = held.get(i)
                held[i] = (asks or bool(old and old[0]), *rest)
        if len(held) > 1:
            yield found()

    return map_arrow(ordered.select(*keys, "set_id", "asks", *columns), run, schema)


def search_cells(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) in every cell. ``rows``: keys, set_id, grp, asks, tokens; a record may be repeated in a cell."""

    def found(held: dict) -> list[tuple]:
        ids = list(held)
        cell = Cell([np.frombuffer(held[i][2], "<u8") for i in ids], [held[i][1] for i in ids])
        return [(ids[q], ids[r]) for q, r in cell.search([k for k, i in enumerate(ids) if held[i][0]], percent)]

    return by_cell(rows, keys, ["grp", "tokens"], found, "a long, b long")


def compare_cells(rows: DataFrame, keys: list[str], percent: int, most: int) -> DataFrame:
    """Pairs (hub, set_id) of every cell that sketches do not rule out, and whether the hub has more than ``most``. ``rows``: keys, set_id, grp, asks, n, sketch."""

    def found(held: dict) -> list[tuple]:
        ids = list(held)
        asks, groups, sizes, sketches = zip(*held.values())
        cell = Sketches(sizes, groups, asks, sketches)
        return [(ids[q], ids[r], more) for q, r, more in cell.pairs(percent, most)]

    return by_cell(rows, keys, ["grp", "n", "sketch"], found, "hub long, set_id long, more boolean")


# -- tables ----------------------------------------------------------------------------------------


def bit_table(df: DataFrame, column: str, bits: int = 25) -> np.ndarray:
    """Which leading bits the hashes of a column have, as packed bits of fixed size. It only saves work: whoever passes
    it is joined exactly afterwards."""
    part = 18

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, bool)
        for batch in batches:
            table[batch.column(0).to_numpy(zero_copy_only=False).view(_U) >> _U(64 - bits)] = True
        chunks = table.reshape(-1, 1 << part)
        used = np.flatnonzero(chunks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([np.packbits(chunks[c]).tobytes() for c in used], pa.binary())], ["chunk", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[c] = total.get(c, 0) | np.frombuffer(b, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([b.tobytes() for b in total.values()], pa.binary())], ["chunk", "bits"])

    out = np.zeros((1 << (bits - part), 1 << (part - 3)), np.uint8)
    parts = map_arrow(df.select(column), some, "chunk long, bits binary").repartition("chunk")
    for c, b in map_arrow(parts, merge, "chunk long, bits binary").collect():
        out[c] = np.frombuffer(b, np.uint8)
    return out.reshape(-1)


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(_U) >> _U(64 - int(math.log2(len(table) * 8)))
    return (table[at >> _U(3)] >> (_U(7) - (at & _U(7))).astype(np.uint8)) & 1 == 1


def _fingerprints(docs: DataFrame) -> DataFrame:
    """Kind 0: doc_id, n, set_id of every row. Kinds 1 and 2: shingles and words that a task has seen several times, with their
    number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def repeated(parts: list[np.ndarray], kind: int, least: int) -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(parts), return_counts=True)
            s, n = s[n >= least], n[n >= least]
            parts.clear()
            columns = [pa.array(np.full(len(s), kind, np.int32)), pa.array(s.view(np.int64)), pa.array(n), pa.nulls(len(s), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["kind", "id", "n", "set_id"])

        words: list[np.ndarray] = []
        for batch in batches:
            sizes, ids = [], []
            for s, _ in shingle_sets(utf8(batch.column(1)), seen=words):
                i = set_id(s) if len(s) else None
                sizes.append(len(s))
                ids.append(i)
                if i is not None and i not in seen:
                    seen.add(i)
                    held.append(s)
                    size += len(s)
                    if size > 2_000_000:
                        yield repeated(held, 1, 2)
                        size = 0
                if sum(map(len, words)) > 2_000_000:
                    yield repeated(words, 2, 4)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())], ["kind", "id", "n", "set_id"])
            if len(seen) > 500_000:
                seen.clear()
        if held:
            yield repeated(held, 1, 2)
        if words:
            yield repeated(words, 2, 4)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "kind int, id long, n long, set_id long")


def _postings(docs: DataFrame, common: Common, words: Common, percent: int) -> DataFrame:
    """token, set_id, n, uncommon: a row per prefix shingle of every set, its first one with the set's sketch. Sets may repeat between tasks."""
    shared = docs.sparkSession.sparkContext.broadcast((common, words))  # at most COMMON shingles and COMMON_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, frequent = shared.value
        seen: set[int] = set()
        for batch in batches:
            token, ids, sizes, uncommon, sketches, rows = [], [], [], [], [], 0

            def out() -> pa.RecordBatch:
                n = [len(t) for t in token]
                columns = [np.concatenate(token).view(np.int64), *(np.repeat(np.array(x, np.int64), n) for x in (ids, sizes, uncommon))]
                own = [x for k, one in zip(n, sketches) for x in (one, *[None] * (k - 1))]
                return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(own, pa.binary())], ["token", "set_id", "n", "uncommon", "sketch"])

            for s, rarest in shingle_sets(utf8(batch.column(0)), frequent):
                if not len(s) or (i := set_id(s)) in seen:
                    continue
                seen.add(i)
                count = shingles.count(s)
                order = np.lexsort((rarest, count))  # ties in hash order
                token.append(s[order[: len(s) - least_overlap(len(s), percent) + 1]])
                ids.append(i)
                sizes.append(len(s))
                uncommon.append(int((count == 0).sum()))
                sketches.append(sketch(s))
                rows += len(token[-1])
                if rows > 200_000:
                    yield out()
                    token, ids, sizes, uncommon, sketches, rows = [], [], [], [], [], 0
            if token:
                yield out()
            if len(seen) > 500_000:
                seen.clear()

    return map_arrow(docs.select(F.col("text").cast("string")), run, "token long, set_id long, n long, uncommon long, sketch binary")


def _sets(docs: DataFrame, needed: DataFrame, firsts: DataFrame) -> DataFrame:
    """set_id and tokens (sorted, little-endian) of the needed sets, one row each, and maybe of others. ``firsts``: set_id and the doc_id, under ``first``, of one document that has it;
    only the texts of these documents are cut."""
    key = F.xxhash64("first").alias("key")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(firsts.join(needed, "set_id", "left_semi").select(key), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(in_table(table.value, batch.column(0).to_numpy(zero_copy_only=False))))
            ids, tokens, size = [], [], 0
            for s, _ in shingle_sets(utf8(batch.column(1))):
                if not len(s) or (i := set_id(s)) in seen:
                    continue
                seen.add(i)
                ids.append(i)
                tokens.append(s.astype("<u8").tobytes())
                size += 8 * len(s)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.binary())], ["set_id", "tokens"])
                    ids, tokens, size = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.binary())], ["set_id", "tokens"])
            if len(seen) > 500_000:
                seen.clear()

    own = docs.select(F.col("doc_id").cast("long").alias("first"), F.col("text").cast("string").alias("text"))
    return map_arrow(own.select(key, "text"), run, "set_id long, tokens binary").dropDuplicates(["set_id"])


def _narrow(df: DataFrame, column: str, table: np.ndarray) -> DataFrame:
    """Rows whose hash passes a bit table."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_table(shared.value, batch.column(column).to_numpy(zero_copy_only=False))))

    return map_arrow(df, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields))


def size_class(n: str, percent: int):
    """Classes such that matches lie in the same or in neighbouring ones, with a margin for rounding."""
    return F.floor(F.log(F.col(n).cast("double")) / (-math.log(percent / 100) * 1.001)).cast("int")


def least_shared(n: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Prefix shingles that matches of sizes n and n_b share at least.

    Of the two prefixes, all shingles of the one that ends first and that the other record has lie in the other's prefix. If c are shared,
    the overlap is c plus the rest of that record at most.
    """
    need = -(-percent * (n + n_b) // (100 + percent))
    own = -(-percent * np.maximum(n, n_b) // 100)
    return need - own + 1


@dataclass
class Job:
    """What the phases of a join share: documents, one doc_id of each set, sketches and their mean length, tables, and the bytes that a round may write."""

    docs: DataFrame
    percent: int
    scratch: Scratch
    firsts: DataFrame
    sketches: DataFrame
    mean_sketch: float
    budget: int

    def rounds(self, volume: float | None, label: str, make: Callable[[Callable], DataFrame]) -> DataFrame:
        """The rows of several rounds, for a phase that would write so many bytes at once. ``make`` gets a function that takes columns and gives the condition of being in this round.
        Files of a round go before the next one writes its own."""
        parts = max(1, math.ceil((volume or 0) / self.budget))
        made = []
        for k in range(parts):
            made.append(self.scratch.save(make(lambda *columns: F.pmod(F.xxhash64(*columns, F.lit(label)), F.lit(parts)) == k), label))  # noqa: B023
            self.scratch.drop()
        return reduce(DataFrame.unionAll, made)

    def similar(self, pairs: DataFrame, label: str) -> DataFrame:
        """hub, hub_n, set_id and n of the pairs (hub, set_id) that sketches do not rule out."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, hub_n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "hub_n"))
                keep = can_match(n, hub_n, batch.column("sketch").to_pylist(), batch.column("hub_sketch").to_pylist(), percent)
                yield batch.select(["hub", "hub_n", "set_id", "n"]).filter(pa.array(keep))

        def make(in_round: Callable) -> DataFrame:
            rows = pairs.filter(in_round("hub", "set_id")).join(self.sketches, "set_id")
            rows = rows.join(self.sketches.toDF("hub", "hub_n", "hub_sketch"), "hub")
            return map_arrow(rows.select("hub", "hub_n", "set_id", "n", "sketch", "hub_sketch"), run, "hub long, hub_n long, set_id long, n long")

        return self.rounds(pairs.count() * (48 + self.mean_sketch), label, make)

    def stars(self, pairs: DataFrame, label: str) -> DataFrame:
        """Links (a, b) among pairs (hub, hub_n, set_id, n), by a search for each hub among its partners, in salted parts."""
        sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"), F.sum(F.col("n") + 4).alias("n"), F.first("hub_n").alias("hub_n"))
        sizes = self.scratch.save(sizes, "hubs")
        volume = sizes.agg(F.sum(8 * (F.col("n") + (F.col("hub_n") + 4) * F.col("salts")))).first()[0]
        if not volume:
            self.scratch.drop("hubs")
            return self.docs.sparkSession.createDataFrame([], "a long, b long")
        members = pairs.join(sizes.select("hub", "salts"), "hub").select("hub", F.pmod(F.xxhash64("set_id"), F.col("salts")).cast("int").alias("salt"), "set_id", F.lit(False).alias("asks"))
        hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("set_id"), F.lit(True).alias("asks"))
        cells = self.scratch.save(members.unionAll(hubs).withColumn("grp", F.col("set_id")), "star-cells")

        def make(in_round: Callable) -> DataFrame:
            own = cells.filter(in_round("hub", "salt"))
            return search_cells(own.join(_sets(self.docs, own.select("set_id"), self.firsts), "set_id"), ["hub", "salt"], self.percent)

        links = self.rounds(volume, label, make)
        self.scratch.drop("hubs", "star-cells")
        return links


def _small_pairs(rows: DataFrame, job: Job) -> DataFrame:
    """Pairs (hub, set_id) of small buckets that can match. ``rows``: token, set_id, n, large (its shingles in large buckets), label."""
    record = F.struct("set_id", "n", "large", "label")
    buckets = rows.groupBy("token").agg(F.collect_list(record).alias("r"), F.min("label").alias("lo"), F.max("label").alias("hi"))  # SMALL at most
    buckets = job.scratch.save(buckets.filter("lo <> hi").select("r"), "mixed-small")
    percent, size = job.percent, F.size("r").cast("long")

    def expand(parts: int, part: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(0)
                cut = lists.offsets.to_numpy().astype(np.int64)
                values = lists.values
                i, n, large, label = (values.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for size in np.unique(np.diff(cut)):
                    a, b = np.triu_indices(size, 1)
                    begin = cut[:-1][np.diff(cut) == size]
                    left.append((begin[:, None] + a).ravel())
                    right.append((begin[:, None] + b).ravel())
                left, right = np.concatenate(left), np.concatenate(right)
                swap = i[left] > i[right]
                left, right = np.where(swap, right, left), np.where(swap, left, right)
                ok = (label[left] != label[right]) & (100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right]))
                ok &= mix(i[left].view(_U) + _U(3) * i[right].view(_U)) % _U(parts) == part
                left, right = left[ok], right[ok]
                need = least_shared(n[left], n[right], percent) - np.minimum(large[left], large[right])
                yield pa.RecordBatch.from_arrays([pa.array(i[left]), pa.array(i[right]), pa.array(need)], ["hub", "set_id", "need"])

        return run

    volume = buckets.agg(F.sum(size * (size - 1) * 20)).first()[0] or 0  # 40 bytes a pair
    parts, made = max(1, math.ceil(volume / job.budget)), []
    for k in range(parts):
        pairs = map_arrow(buckets, expand(parts, k), "hub long, set_id long, need long")
        shared = pairs.groupBy("hub", "set_id").agg(F.count("*").alias("c"), F.first("need").alias("need"))
        made.append(job.scratch.save(shared.filter("c >= need").select("hub", "set_id"), "small-pairs"))
        job.scratch.drop()
    job.scratch.drop("mixed-small")
    return reduce(DataFrame.unionAll, made)


def _cells(marked: DataFrame, job: Job, most: int) -> DataFrame:
    """Pairs (hub, set_id, more) of records of different components that share a large bucket, up to ``most`` for a record of a block; ``more`` if it has others. ``marked``: token, set_id, n, label."""
    scratch = job.scratch
    mixed = marked.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("set_id").alias("first")).filter("lo <> hi")
    edges = marked.join(mixed.select("token", "first"), "token").select("set_id", "first", "n", "label")
    edges = scratch.save(edges.distinct(), "mixed")
    cells = components(edges, "set_id", "first").withColumnsRenamed({"node": "set_id", "root": "cell"})
    rows = edges.select("set_id", "n", "label").distinct().join(cells, "set_id").withColumn("class", size_class("n", job.percent))
    # Records of a cell's largest component are only compared with the others.
    shares = rows.groupBy("cell", "label").agg(F.count("*").alias("records"))
    major = shares.groupBy("cell").agg(F.max_by("label", F.struct("records", "label")).alias("largest"))
    rows = rows.join(major, "cell").withColumn("major", F.col("label") == F.col("largest")).drop("largest")
    counts = rows.groupBy("cell", "class", "major").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("records"))
    rows = rows.join(counts.drop("records"), ["cell", "class", "major"]).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    rows = scratch.save(rows.select("cell", "class", "major", "block", "set_id", "label"), "cell-rows")
    each = F.col("records") / F.col("blocks")
    others = counts.filter("NOT major").select("cell", F.col("class").alias("class_a"), F.col("blocks").alias("blocks_a"), each.alias("each_a"))
    b = counts.select("cell", F.col("class").alias("class_b"), "major", F.col("blocks").alias("blocks_b"), each.alias("each_b"))
    near = others.join(b, "cell").filter("abs(class_a - class_b) <= 1 AND (major OR class_a <= class_b)")
    near = near.withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1))).withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)))
    near = near.filter("major OR class_a < class_b OR block_a <= block_b").select("cell", "class_a", "block_a", "class_b", "block_b", F.col("major").alias("major_b"), (F.col("each_a") + F.col("each_b")).alias("each"))
    near = scratch.save(near, "cell-pairs")
    records = near.agg(F.sum("each")).first()[0] or 0
    pair = ["cell", "class_a", "block_a", "class_b", "block_b", "major_b"]
    rows = scratch.save(rows.join(job.sketches, "set_id"), "cell-sketches")

    def make(in_round: Callable) -> DataFrame:
        own = near.drop("each").filter(in_round("cell", "class_a", "block_a", "class_b", "block_b", "major_b"))
        # The searching side, then the searched one.
        a_side = own.join(rows.filter("NOT major").withColumnsRenamed({"class": "class_a", "block": "block_a"}).drop("major"), ["cell", "class_a", "block_a"])
        b_side = own.join(rows.withColumnsRenamed({"class": "class_b", "block": "block_b", "major": "major_b"}), ["cell", "class_b", "block_b", "major_b"])
        columns = ["set_id", F.col("label").alias("grp"), "n", "sketch"]
        sides = a_side.select(*pair, *columns, F.lit(True).alias("asks")).unionAll(b_side.select(*pair, *columns, F.lit(False).alias("asks")))
        return compare_cells(sides, pair, job.percent, most)

    found = job.rounds(2 * records * (80 + job.mean_sketch), "cell-found", make)
    scratch.drop("mixed", "cell-rows", "cell-pairs", "cell-sketches")
    return found


def frequent(prints: DataFrame, kind: int, least: int, most: int, scratch: Scratch) -> Common:
    """About the ``most`` most frequent hashes of a kind, and never more, seen ``least`` times at least. A cutoff is found first from the
    number of hashes by count, so that the driver gets only these rows; of those at the cutoff a range of hashes is taken."""
    often = scratch.save(prints.filter(F.col("kind") == kind).groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "often")
    band = F.floor(16 * F.log2(F.col("n").cast("double"))).cast("int")  # at most 1024 bands
    cut, share, taken = 0, 1.0, 0
    for b, v in often.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect():
        if taken + v > most:
            cut, share = b, 0.98 * (most - taken) / v
            break
        taken += v
    last = F.lit(int(-(2**63) + share * (2**64 - 2048)))
    top = often.filter(band > cut).unionAll(often.filter((band == cut) & (F.col("id") <= last)).limit(most - taken)).toArrow()
    h = top.column("id").to_numpy().view(_U)
    order = np.argsort(h)
    return Common(h[order], top.column("n").to_numpy()[order])


def jaccard_components(docs: DataFrame, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row.

    Documents without words are linked with nothing. A repeated row is linked with its twin. Null doc_ids stay null and count
    as larger than any other.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.save(_fingerprints(docs), "prints")
    rows = prints.filter("kind = 0").select(F.col("id").alias("doc_id"), "n", "set_id")
    rows = scratch.save(rows, "rows")
    common, words = frequent(prints, 1, 4, COMMON, scratch), frequent(prints, 2, 4, COMMON_WORDS, scratch)
    scratch.drop("prints", "often")
    postings = scratch.save(_postings(docs, common, words, percent), "postings")

    spark = docs.sparkSession
    sketches = scratch.save(postings.filter("sketch IS NOT NULL").select("set_id", "n", "sketch").dropDuplicates(["set_id"]), "sketches")
    firsts = scratch.save(rows.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first")), "firsts")
    shingles, mean = rows.agg(F.sum("n")).first()[0], sketches.agg(F.avg(F.length("sketch"))).first()[0]
    job = Job(docs, percent, scratch, firsts, sketches, mean or 0.0, max(ROUND, 8 * (shingles or 0) // ROUND_PARTS))

    hub = F.min(F.struct("uncommon", F.col("set_id").alias("hub"), F.col("n").alias("hub_n"))).alias("h")
    shared = postings.groupBy("token").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).filter("lo <> hi")
    shared = scratch.save(shared.select("token"), "shared")
    scratch.drop()
    rows_of = _narrow(postings.drop("sketch"), "token", bit_table(shared, "token")).join(shared, "token").distinct()
    rows_of = scratch.save(rows_of, "bucket-rows")
    scratch.drop("postings", "shared")
    buckets = rows_of.groupBy("token").agg(F.count("*").alias("records"), hub).select("token", "records", "h.hub", "h.hub_n")
    placed = scratch.save(rows_of.join(buckets, "token"), "buckets")
    scratch.drop("bucket-rows")

    to_hub = placed.filter(f"set_id <> hub AND 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").select("set_id", "hub").distinct()
    to_hub = scratch.save(to_hub, "to-hub")
    links = job.stars(job.similar(to_hub, "hub-pairs"), "star-links")
    scratch.drop("to-hub", "hub-pairs")

    large = placed.filter(f"records > {SMALL}")
    counted = large.groupBy("set_id").agg(F.count("*").alias("large"))
    marked = placed.select("token", "records", "set_id", "n").join(_labels(links), "set_id", "left").join(counted, "set_id", "left")
    marked = scratch.save(marked.withColumns({"label": F.coalesce("label", "set_id"), "large": F.coalesce("large", F.lit(0).cast("long"))}), "marked")
    scratch.drop("buckets")
    pairs = _small_pairs(marked.filter(f"records <= {SMALL}"), job)
    marked = scratch.save(marked.filter(f"records > {SMALL}").select("token", "set_id", "n", "label"), "marked-large")
    scratch.drop("marked")
    most = PARTNERS
    while True:
        found = _cells(marked, job, most)
        more = found.filter("more").limit(1).count()
        pairs = scratch.save(pairs.unionAll(found.select("hub", "set_id")).distinct(), "pairs")
        scratch.drop("small-pairs", "cell-found")
        links = links.unionAll(job.stars(job.similar(pairs, "similar-pairs"), "pair-links"))
        scratch.drop("pairs", "similar-pairs")
        if not more:
            break
        # Some record of a cell has more partners; those of its own component by now don't count.
        most *= 16
        pairs = spark.createDataFrame([], "hub long, set_id long")
        marked = scratch.save(marked.drop("label").join(_labels(links), "set_id", "left").withColumn("label", F.coalesce("label", "set_id")), "marked-again")
    scratch.drop("marked-large", "marked-again", "sketches")
    roots = components(links, "a", "b").withColumnsRenamed({"node": "set_id"})

    least = scratch.save(firsts.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), "set-roots")
    scratch.drop("star-links", "pair-links", "firsts")
    ids = least.groupBy("root").agg(F.min("first").alias("component_id"))
    known = least.join(ids, "root").select("set_id", "component_id")
    out = rows.join(known, "set_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _labels(links: DataFrame) -> DataFrame:
    return components(links, "a", "b").withColumnsRenamed({"node": "set_id", "root": "label"})


def keep_one(docs: DataFrame, percent: int = 90) -> DataFrame:
    """One row of each group, that with the smallest doc_id, with all its columns. Of repeated doc_ids one row stays; rows
    without a doc_id can't be told apart and stay."""
    first = jaccard_components(docs, percent).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)
