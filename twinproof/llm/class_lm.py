"""Class-based n-gram model: P(word | previous word) = P(class | previous class) * P(word | class).

Exchange clustering finds the classes: a word moves to the class where the bigram likelihood of the classes is largest. A start is
found on a table of fixed size, whose units are the most frequent words one by one and all other words by their ending; units move in turn.
From there every training word moves by itself: sweeps count each word's neighbouring classes as a table keyed by word, and
tasks choose each word's best class against the k x k class table. All words move at once, so a sweep
that lowers the likelihood is dropped.

Within a class words share by absolute discounting: (c - D) / n for a word with count c of a class with n tokens, and D * V / n for its
unknown words together, V being the class's known words. Unknown words have the class that most known words of their ending have,
and share its part by endings. Transitions are add-one smoothed over the classes.

Words and their counts cover the whole training corpus and never meet in one place. Documents are dealt into blocks; each block lists its
words once and stores its texts as places in that list. Counts are summed per word, and counts and classes come back to the
block by joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.llm.common import LOWER, delete, flat, fold, forget, map_arrow, release, saved, ship, slices, utf8, word_hashes
from twinproof.session import shared_dir

_U = np.uint64
#: The end token's hash, and its unit, which is always 0.
END = np.array([0x5D0C_E21F_7A11_93B7], _U)


@dataclass(frozen=True)
class Settings:
    head: int = 8192  # units of one word each, for the start only
    tail: int = 4096  # endings
    classes: int = 32  # 64 at most
    sweeps: int = 3  # of the start
    refine: int = 2  # of all words
    block_bytes: int = 28 << 20  # text of a block, about


@dataclass
class Tokens:
    """Word hashes of some texts with an end token after each, ending codes, and where texts begin."""

    hashes: np.ndarray
    endings: np.ndarray
    begin: np.ndarray


def tokens(texts: list[bytes], tail: int) -> Tokens:
    data, at = flat(texts)
    h, s, e = word_hashes(data, at, lower=True)
    low = LOWER[data].astype(np.uint32)
    code = np.zeros(len(h), np.uint32)
    for back in (1, 2, 3):  # the last three bytes
        pos = e - back
        code = code * np.uint32(257) + np.where(pos >= s, low[np.maximum(pos, 0)] + np.uint32(1), np.uint32(0)).astype(np.uint32) if len(data) else code
    code = ((code * np.uint32(0x9E3779B1)) >> np.uint32(8)) % np.uint32(tail)
    first = np.searchsorted(s, at)
    n = len(at) - 1
    place = first[1:] + np.arange(n)  # of the end tokens
    hashes, endings = np.empty(len(h) + n, _U), np.zeros(len(h) + n, np.int32)
    word = np.ones(len(h) + n, bool)
    word[place] = False
    hashes[word], endings[word] = h, code.astype(np.int32)
    hashes[place] = END
    return Tokens(hashes, endings, first + np.arange(n + 1))


@dataclass
class Units:
    """Frequent words (sorted hashes and their units from 1 on); other words have unit 1 + head + ending."""

    words: np.ndarray
    units: np.ndarray
    head: int

    def of(self, t: Tokens) -> np.ndarray:
        out = t.endings + np.int32(1 + self.head)
        if len(self.words):
            k = np.searchsorted(self.words, t.hashes)
            k[k == len(self.words)] = 0
            known = self.words[k] == t.hashes
            out[known] = self.units[k[known]]
        out[t.begin[1:] - 1] = 0
        return out


def _counted(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum (hash, count) pairs; the ending goes along."""
    h, c, e = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h, kind="stable")
    h, c, e = h[order], c[order], e[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(first) else c, e[first]


def _added(keys: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum numbers by key."""
    key, n = np.concatenate(keys), np.concatenate(numbers)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _packed(ids: np.ndarray) -> bytes:
    """Places as compressed byte planes."""
    return pa.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


class _Block:
    """What is kept of a block while its texts pass: each slice's words, counts and places. The texts themselves are not."""

    def __init__(self, block: int, tail: int):
        self.block, self.tail = block, tail
        self.words, self.counts, self.endings, self.places = [], [], [], []
        self.doc_ids, self.training, self.sizes = [], [], []

    def add(self, rows: pa.RecordBatch) -> None:
        texts, training = utf8(rows.column("text")), rows.column("training").to_numpy(zero_copy_only=False)
        doc_ids = rows.column("doc_id")
        for i, j in slices(texts):
            t = tokens(texts[i:j], self.tail)
            w, first, own = np.unique(t.hashes, return_index=True, return_inverse=True)
            size = np.diff(t.begin)
            self.words.append(w)
            self.endings.append(t.endings[first])
            self.counts.append(np.bincount(own, np.repeat(training[i:j], size), len(w)).astype(np.int64))
            self.places.append(_packed(own))
            self.doc_ids.append(doc_ids.slice(i, j - i).to_pylist())
            self.training.append(training[i:j].tolist())
            self.sizes.append(size.tolist())

    def rows(self) -> Iterator[pa.RecordBatch]:
        h, c, e = _counted(list(zip(self.words, self.counts, self.endings)))
        order = np.argsort(-c, kind="stable")  # frequent words have small places
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        h, c, e = h[order], c[order], e[order].astype(np.int32)
        for i in range(0, len(h), 20_000):
            n = len(h[i : i + 20_000])
            yield self._batch(n, id=np.arange(i, i + n, dtype=np.int32), word=h[i : i + n].view(np.int64), ending=e[i : i + n], n=c[i : i + n])
        place = np.argsort(h, kind="stable")
        for w, p, doc_ids, training, sizes in zip(self.words, self.places, self.doc_ids, self.training, self.sizes):
            own = place[np.searchsorted(h, w, sorter=place)]  # the slice's words by their place in the block's list
            yield self._batch(1, doc_ids=[doc_ids], training=[training], sizes=[sizes], tokens=[_packed(own[_unpacked(p, sum(sizes))])])

    def _batch(self, size: int, /, **columns) -> pa.RecordBatch:
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in BLOCK_WORDS]
        arrays[0] = pa.array(np.full(size, self.block, np.int32))
        return pa.RecordBatch.from_arrays(arrays, BLOCK_WORDS.names)


BLOCK_WORDS = pa.schema([
    ("block", pa.int32()), ("id", pa.int32()), ("word", pa.int64()), ("ending", pa.int32()), ("n", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("training", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary()),
])


def block_words(docs: DataFrame, conf: Settings, blocks: int | None = None) -> DataFrame:
    """A row per block and word: block, id (its place in the block's list), word, ending, n (training tokens, may be 0). And rows with some
    texts of a block each: block, doc_ids, training, sizes, tokens (places of their words and end tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    if now is None or now.block != block[i]:
                        if now:
                            yield from now.rows()
                        now = _Block(int(block[i]), conf.tail)
                    now.add(batch.slice(i, j - i))
        if now:
            yield from now.rows()
        now = None
        release()

    schema = "block int, id int, word long, ending int, n long, doc_ids array<long>, training array<boolean>, sizes array<int>, tokens binary"
    rows = docs.select("block", "doc_id", "text", "training")
    rows = rows.repartition(blocks, "block") if blocks else rows.repartition("block")
    return map_arrow(rows.sortWithinPartitions("block"), run, schema)


def profiles(docs: DataFrame, units: Units, classes: np.ndarray, conf: Settings) -> tuple[np.ndarray, np.ndarray]:
    """How often each unit precedes and follows each class in the training texts. Texts stand between end tokens."""
    n, k = 1 + conf.head + conf.tail, conf.classes
    shared = docs.sparkSession.sparkContext.broadcast((units, classes))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cls = shared.value
        count = np.zeros((n, 2 * k), np.int64)
        for batch in batches:
            texts = utf8(batch.column("text"))
            for i, j in slices(texts):
                u = own.of(tokens(texts[i:j], conf.tail))
                left, right = np.append(0, u[:-1]), u
                count += np.bincount(left.astype(np.int64) * (2 * k) + cls[right], minlength=n * 2 * k).reshape(n, 2 * k)
                count += np.bincount(right.astype(np.int64) * (2 * k) + k + cls[left], minlength=n * 2 * k).reshape(n, 2 * k)
        some = np.flatnonzero(count.any(1))
        values = pa.array([r.tobytes() for r in count[some].astype("<i4")], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), values], ["unit", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for u, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[u] = total.get(u, 0) + np.frombuffer(c, "<i4").astype(np.int64)
        columns = [pa.array(list(total), pa.int32()), pa.array([c.astype("<i8").tobytes() for c in total.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["unit", "counts"])

    parts = map_arrow(docs.filter("training").select("text"), run, "unit int, counts binary")
    out = np.zeros((n, 2 * k), np.int64)
    for u, c in map_arrow(parts.repartition("unit"), add, "unit int, counts binary").collect():  # one row per unit
        out[u] = np.frombuffer(c, "<i8")
    return out[:, :k], out[:, k:]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(after: np.ndarray, before: np.ndarray, classes: np.ndarray, k: int) -> np.ndarray:
    """One sweep: every unit in turn moves to the class of highest likelihood, given its neighbours' classes."""
    classes = classes.copy()
    bigrams = np.zeros((k, k))
    np.add.at(bigrams, classes, after.astype(float))
    row, column = bigrams.sum(1), bigrams.sum(0)

    size = after.sum(1)
    for u in np.argsort(-size, kind="stable"):
        if size[u] == 0 or u == 0:
            continue
        a, f, b = classes[u], after[u].astype(float), before[u].astype(float)
        bigrams[a] -= f
        bigrams[:, a] -= b
        np.maximum(bigrams, 0, out=bigrams)
        row[a] -= f.sum()
        column[a] -= b.sum()
        gain = (_xlogx(bigrams + f) - _xlogx(bigrams)).sum(1) + (_xlogx(bigrams + b[:, None]) - _xlogx(bigrams)).sum(0)
        for margin, more in ((row, f.sum()), (column, b.sum())):
            m = np.maximum(margin, 0)
            gain -= _xlogx(m + more) - _xlogx(m)
        gain[0] = -np.inf  # the end token's own class
        c = int(np.argmax(gain))
        classes[u] = c
        bigrams[c] += f
        bigrams[:, c] += b
        row[c] += f.sum()
        column[c] += b.sum()
    return classes


def neighbours(parts: DataFrame, classes: DataFrame, k: int, moving: bool) -> DataFrame:
    """block, id, word, cls, counts: how often a block's training word precedes (slots from 0) and follows (from k) each class, as slot plus
    128 times a number; empty if not ``moving``. A row with id -1 has the block's table of class pairs. ``classes``: block, id, word, cls."""
    most = (1 << 25) - 1

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        ids, words = known.column("id").to_numpy(), known.column("word").to_numpy()
        cls = known.column("cls").to_numpy()
        place = np.argsort(ids)
        ids, words, cls = ids[place], words[place], cls[place]
        of = np.zeros(1 + (ids[-1] if len(ids) else 0), np.int64)
        of[ids] = cls
        pairs, keys, numbers = np.zeros(k * k, np.int64), [], []
        for training, sizes, data in zip(*(texts.column(c).to_pylist() for c in ("training", "sizes", "tokens"))):
            w = _unpacked(data, sum(sizes))[np.repeat(np.array(training, bool), sizes)]
            if not len(w):
                continue
            right = of[w]
            left = np.append(0, right[:-1])  # the end token's class is 0
            pairs += np.bincount(left * k + right, minlength=k * k)
            if moving:
                key, n = np.unique(np.append(w[:-1] * (2 * k) + right[1:], w * (2 * k) + k + left), return_counts=True)
                keys.append(key)
                numbers.append(n)
                if len(keys) > 4:  # what slices share is added up at once
                    keys, numbers = ([x] for x in _added(keys, numbers))
        key, n = _added(keys, numbers) if keys else (np.zeros(0, np.int64),) * 2
        times = 1 + (n - 1) // most  # numbers too large for an entry take several
        number = np.repeat(np.minimum(n, most), times)
        last = np.cumsum(times) - 1
        number[last] = n - (times - 1) * most
        key = np.repeat(key, times)
        entry = (key % (2 * k) + (number << 7)).astype("<u4")
        at = 4 * np.append(np.searchsorted(key // (2 * k), ids), len(key)).astype(np.int32)
        counts = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(entry.tobytes())])
        block = (texts.column("of") if len(texts) else known.column("block"))[0].as_py()
        key = n = number = keys = numbers = None
        release()
        return pa.table({
            "block": pa.array(np.full(len(ids) + 1, block, np.int32)),
            "id": pa.array(np.append(ids, -1).astype(np.int32)),
            "word": pa.array(np.append(words, 0)),
            "cls": pa.array(np.append(cls, 0).astype(np.int32)),
            "counts": pa.concat_arrays([counts, pa.array([pairs.astype("<i8").tobytes()], pa.binary())]),
        })

    ship(parts.sparkSession)
    left, right = parts.select(F.col("block").alias("of"), "training", "sizes", "tokens"), classes.select("block", "id", "word", "cls")
    return left.groupBy("of").cogroup(right.groupBy("block")).applyInArrow(run, "block int, id int, word long, cls int, counts binary")


def class_pairs(counted: DataFrame, k: int) -> np.ndarray:
    """The k x k table of class pairs, from the blocks' tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for c in batch.column(0).to_pylist():
                total += np.frombuffer(c, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total)], ["pair", "n"])

    out = np.zeros(k * k)
    for pair, n in map_arrow(counted.filter("id < 0").select("counts"), run, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        out[pair] = n
    return out.reshape(k, k)


def likelihood(bigrams: np.ndarray) -> float:
    return float(_xlogx(bigrams).sum() - _xlogx(bigrams.sum(1)).sum() - _xlogx(bigrams.sum(0)).sum())


def best_classes(after: np.ndarray, before: np.ndarray, own: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """The class of highest likelihood for each word, if it alone moves, as in ``exchange``."""
    gain = np.zeros(after.shape)
    every = np.arange(len(own))
    for count, other, table in ((after, before, bigrams), (before, after, bigrams.T)):
        w, j = np.nonzero(count)
        if len(w):
            n = count[w, j]
            rest = table.T[j]  # without the word itself
            inside = j == own[w]
            rest[inside] -= other[w[inside]]
            rest[np.arange(len(w)), own[w]] -= n
            np.maximum(rest, 0, out=rest)
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            gain[w[first]] += np.add.reduceat(_xlogx(rest + n[:, None]) - _xlogx(rest), first)
        more = count.sum(1)
        margin = np.repeat(table.sum(1)[None], len(own), 0)
        margin[every, own] -= more
        np.maximum(margin, 0, out=margin)
        gain -= _xlogx(margin + more[:, None]) - _xlogx(margin)
    gain[:, 0] = -np.inf  # the end token's own class
    best = gain.argmax(1)
    return np.where(gain[every, best] > gain[every, own] + 1e-9, best, own)


def move(counted: DataFrame, bigrams: np.ndarray) -> DataFrame:
    """block, id, word, cls of every training word of the blocks, each word in its best class."""
    k = len(bigrams)
    shared = counted.sparkSession.sparkContext.broadcast(bigrams)  # k x k
    end = END.view(np.int64)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen(rows: pa.Table) -> pa.RecordBatch:
            block, ids, word, cls = (rows.column(c).to_numpy() for c in range(4))
            data = rows.column(4).to_pylist()
            new = np.append(True, word[1:] != word[:-1])
            at = np.cumsum(new) - 1
            entry = np.frombuffer(b"".join(data), "<u4").astype(np.int64)
            owner = np.repeat(at, [len(d) // 4 for d in data])
            n = at[-1] + 1
            count = np.bincount(owner * (2 * k) + (entry & 127), entry >> 7, n * 2 * k).reshape(n, 2 * k)
            own = cls[new].astype(np.int64)
            best = np.concatenate([best_classes(count[i : i + 1000, :k], count[i : i + 1000, k:], own[i : i + 1000], shared.value) for i in range(0, n, 1000)])
            best[word[new] == end] = 0
            return pa.RecordBatch.from_arrays([pa.array(block), pa.array(ids), pa.array(word), pa.array(best[at].astype(np.int32))], ["block", "id", "word", "cls"])

        held: list[pa.RecordBatch] = []  # of one word, whose rows may go on
        for batch in batches:
            if not len(batch):
                continue
            word = batch.column(2).to_numpy()
            first = int(np.searchsorted(word, word[-1]))
            if first or (held and held[-1].column(2)[0].as_py() != word[0]):
                yield chosen(pa.Table.from_batches([*held, batch.slice(0, first)]))
                held = []
            held.append(batch.slice(first))
        if held:
            yield chosen(pa.Table.from_batches(held))
        held = []
        release()

    rows = counted.filter("id >= 0").repartition("word").sortWithinPartitions("word")
    return map_arrow(rows.select("block", "id", "word", "cls", "counts"), run, "block int, id int, word long, cls int")


@dataclass
class Model:
    """Units are single words up to ``units.head``, and classes or other groups of words after it."""

    units: Units
    classes: np.ndarray
    transition: np.ndarray  # log10 P(class | class before)
    unit: np.ndarray  # log10 P(unit | its class)
    size: np.ndarray  # training tokens of each unit
    kinds: np.ndarray  # known words of each unit
    discount: float | np.ndarray  # of all units or of each
    total: int
    vocabulary: int
    endings: np.ndarray | None = None  # class of unknown words by ending
    share: np.ndarray | None = None  # log10 P(ending | unknown word of its class)


def start(docs: DataFrame, known: DataFrame, conf: Settings) -> tuple[Units, np.ndarray]:
    """Classes of units, to begin with."""
    end = int(END.view(np.int64)[0])
    top = known.filter(F.col("word") != end).orderBy(F.desc("c"), "word").limit(conf.head).select("word").collect()
    hashes = np.array([r[0] for r in top], np.int64).view(_U)
    order = np.argsort(hashes)
    units = Units(hashes[order], (1 + order).astype(np.int32), conf.head)
    n, k = 1 + conf.head + conf.tail, conf.classes
    # Frequent words seed the classes one by one; the end token is alone in class 0.
    classes = 1 + np.arange(n) % (k - 1)
    classes[0] = 0
    for _ in range(conf.sweeps):
        after, before = profiles(docs, units, classes, conf)
        classes = exchange(after, before, classes, k)
    return units, classes


def begin(listed: DataFrame, units: Units, classes: np.ndarray) -> DataFrame:
    """block, id, word, cls of the blocks' training words, by their units."""
    shared = listed.sparkSession.sparkContext.broadcast((units, classes))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cls = shared.value
        for batch in batches:
            word = batch.column(2).to_numpy().view(_U)
            t = Tokens(word, batch.column(3).to_numpy(), np.zeros(1, np.int64))
            out = np.where(word == END, 0, cls[own.of(t)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out)], ["block", "id", "word", "cls"])

    return map_arrow(listed.filter("n > 0").select("block", "id", "word", "ending"), run, "block int, id int, word long, cls int")


def word_classes(docs: DataFrame, listed: DataFrame, parts: DataFrame, known: DataFrame, conf: Settings) -> tuple[DataFrame, np.ndarray]:
    """word, cls of every training word, and the table of class pairs."""
    now = begin(listed, *start(docs, known, conf))
    best = None
    spark = docs.sparkSession
    for sweep in range(conf.refine + 1):
        path = shared_dir(spark, "neighbours")
        neighbours(parts, now, conf.classes, sweep < conf.refine).write.option("compression", "zstd").parquet(path)
        counted = spark.read.parquet(path)
        bigrams = class_pairs(counted, conf.classes)
        if best and likelihood(bigrams) <= likelihood(best[1]):
            delete(spark, path)
            break
        if best:
            delete(spark, best[2])  # nothing reads the earlier sweep any more
        else:
            forget(spark)  # the start's and the first sweep's shuffles are as large as the texts' places
        best = counted, bigrams, path
        if sweep < conf.refine:
            now = move(counted, bigrams)
    counted, bigrams, path = best
    classes = saved(counted.filter("id >= 0").groupBy("word").agg(F.min("cls").alias("cls")), "classes")
    delete(spark, path)
    return classes, bigrams


def train(bigrams: np.ndarray, known: DataFrame, conf: Settings) -> Model:
    """``known``: word, ending, c (summed training count), cls of every training word, stored."""
    total, vocabulary, ones, twos = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    k = conf.classes
    transition = np.log10((bigrams + 1) / (bigrams + 1).sum(1, keepdims=True))
    kinds, size = np.zeros(k, np.int64), np.zeros(k, np.int64)
    for c, v, s in known.groupBy("cls").agg(F.count("*"), F.sum("c")).collect():  # one row per class
        kinds[c], size[c] = v, s
    # An ending that no known word has goes to the class with most words.
    endings, seen = np.full(conf.tail, 1 + int(kinds[1:].argmax())), np.ones(conf.tail)
    by = known.filter("cls > 0").groupBy("ending", "cls").agg(F.count("*").alias("v")).groupBy("ending")
    for e, c, v in by.agg(F.max_by("cls", F.struct("v", -F.col("cls"))), F.sum("v")).collect():  # one row per ending
        endings[e], seen[e] = c, 1 + v
    mass = np.bincount(endings, seen, k)
    discount = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.05), 0.95)
    # A class without an ending has no unknown words.
    return Model(
        Units(np.zeros(0, _U), np.zeros(0, np.int32), 0), np.arange(k), transition, np.zeros(k), size, kinds,
        np.where(mass > 0, discount, 0.0), int(total), int(vocabulary), endings, np.log10(seen / mass[endings]),
    )


def word_log(model: Model, unit: np.ndarray, c: np.ndarray) -> np.ndarray:
    """log10 P(word | unit) for words with training count ``c``."""
    size, kinds = model.size[unit].astype(float), model.kinds[unit].astype(float)
    discount = np.broadcast_to(model.discount, model.size.shape)[unit]
    alone = (unit <= model.units.head)  # one word: the unit is the word
    p = np.where(c > 0, (c - discount) / np.maximum(size, 1), discount * np.maximum(kinds, 1) / np.maximum(size, 1))
    p = np.where(size > 0, p, 1.0)
    return np.where(alone, 0.0, np.log10(p))


def word_scores(model: Model, word: np.ndarray, ending: np.ndarray, c: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, base score and log10 P(word | class) of words; ``cls`` counts for known words only."""
    cls = np.where(word == END.view(np.int64)[0], 0, np.where(c > 0, cls, model.endings[ending]))
    base = np.log10((c + 1) / (model.total + 1.0 * (model.vocabulary + 1)))
    return cls, base, model.unit[cls] + word_log(model, cls, c) + np.where((c > 0) | (cls == 0), 0.0, model.share[ending])


def score_documents(docs: DataFrame, conf: Settings = Settings(), folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null or empty text is its end token alone. A null doc_id is training text. With no training text at all the base is that of an
    empty vocabulary. Repeated rows are scored and counted each time. A very long text is tokenized in slices and takes a block
    of its own size; a task keeps its words and packed places, 2 to 3 bytes a token, and no text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size, n = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = max(1, math.ceil((size or 0) / conf.block_bytes))
    rows = rows.withColumns({
        "training": F.coalesce(fold(F.col("doc_id"), folds) != held, F.lit(True)),
        # The row's place in the input keeps repeated rows apart.
        "block": F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"),
    })
    stored = saved(block_words(rows, conf, blocks), "block-words")
    forget(docs.sparkSession)
    listed, parts = stored.filter("id IS NOT NULL"), stored.filter("id IS NULL")
    words = saved(listed.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("c")).filter("c > 0"), "words")
    forget(docs.sparkSession)
    classes, bigrams = word_classes(rows, listed, parts, words, conf)
    words = saved(words.join(classes, "word"), "word-classes")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(bigrams, words, conf))  # fixed size
    forget(spark)
    ship(spark)

    def score(texts: pa.Table, dictionary: pa.Table) -> pa.Table:
        m = shared.value
        ids = dictionary.column("id").to_numpy()
        place = np.argsort(ids)
        word, ending, c, of = (dictionary.column(x).to_numpy()[place] for x in ("word", "ending", "c", "cls"))
        cls, base, own = word_scores(m, word, ending, c, of)
        out: dict[str, list] = {x: [] for x in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        for doc_ids, training, sizes, data in zip(*(texts.column(x).to_pylist() for x in ("doc_ids", "training", "sizes", "tokens"))):
            w = _unpacked(data, sum(sizes))
            first = np.cumsum(sizes) - sizes
            right = cls[w]
            mine = m.transition[np.append(0, right[:-1]), right] + own[w]
            out["doc_id"] += doc_ids
            out["held_out"] += [not x for x in training]
            out["n_tokens"] += sizes
            for name, x in (("n_known", (c > 0).astype(np.int64)[w]), ("base_score", base[w]), ("score", mine)):
                out[name] += np.add.reduceat(x, first).tolist()
        release()
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        rows = {name: pa.array(x, kind) for (name, x), kind in zip(out.items(), kinds)}
        return pa.table(rows | {"train_tokens": pa.array(np.full(len(out["doc_id"]), m.total, np.int64))})

    counts = listed.select("block", "id", "word", "ending").join(words.select("word", "c", "cls"), "word", "left")
    counts = counts.select("block", "id", "word", "ending", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("cls", F.lit(0)).alias("cls"))
    scored = parts.select(F.col("block").alias("of"), "doc_ids", "training", "sizes", "tokens").groupBy("of").cogroup(counts.groupBy("block")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, train_tokens long"
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
