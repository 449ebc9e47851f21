"""Supervised subword embeddings: a document is the mean of learned vectors of its words and of their character n-grams.

Words and n-grams are hashed into a fixed number of vectors; a softmax over two classes reads the mean. Training is
stochastic gradient descent in numpy over a bounded sample of labelled rows. As the output layer is linear before
the softmax, scoring adds one number per word and n-gram.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.common import SPACE, flat, fold, map_arrow, numbered, slices, utf8, word_hashes


@dataclass(frozen=True)
class Settings:
    bits: int = 16  # vectors for words, and as many for n-grams
    sizes: tuple[int, ...] = (3, 4)
    width: int = 8
    epochs: int = 2
    rate: float = 30.0
    per_class: int = 1000  # labelled rows of each class that training takes at most
    seed: int = 7


def features(texts: list[bytes], conf: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice of texts: its bounds, every feature's bucket, and the index of the text it belongs to, in text order per kind."""
    mask = np.uint64((1 << conf.bits) - 1)
    for i, j in slices(texts):
        data, at = flat(texts[i:j])
        h, s, _ = word_hashes(data, at, lower=False)
        words = np.repeat(np.arange(j - i, dtype=np.int32), np.diff(np.searchsorted(s, at)))
        yield i, j, (h & mask).astype(np.int32), words
        blank = SPACE[data]
        b = np.where(blank, np.uint8(32), data).astype(np.uint32)
        owner = np.repeat(np.arange(j - i, dtype=np.int32), np.diff(at))
        for n in conf.sizes:
            if len(b) < n:
                continue
            m = len(b) - n + 1
            code = np.zeros(m, np.uint32)
            ok = owner[:m] == owner[n - 1 :]
            for k in range(n):
                code = code * np.uint32(0x01000193) + b[k : k + m]
                if 0 < k < n - 1:  # the n-gram lies in one word and its edges
                    ok &= ~blank[k : k + m]
            code = (code[ok] + np.uint32(n)) * np.uint32(0x9E3779B1)
            yield i, j, (code >> np.uint32(32 - conf.bits)).astype(np.int32) + (1 << conf.bits), owner[:m][ok]


def bags(texts: list[bytes], conf: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and how often it has them."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for i, j, bucket, owner in features(texts, conf):
        cut = np.searchsorted(owner, np.arange(j - i + 1))
        for k in range(j - i):
            parts[i + k].append(bucket[cut[k] : cut[k + 1]])
    return [np.unique(np.concatenate(p) if p else np.zeros(0, np.int32), return_counts=True) for p in parts]


@dataclass
class Model:
    weights: np.ndarray  # what each bucket adds to the log odds of label 1
    bias: float

    def scores(self, texts: list[bytes], conf: Settings) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for i, j, bucket, owner in features(texts, conf):
            total[i:j] += np.bincount(owner, self.weights[bucket], j - i)
            count[i:j] += np.bincount(owner, minlength=j - i)
        z = np.clip(total / np.maximum(count, 1) + self.bias, -500, 500)
        return 1 / (1 + np.exp(-z))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], good: int, bad: int, conf: Settings) -> Model:
    """Stochastic gradient descent over (buckets, counts, label). ``good`` and ``bad`` count all labelled rows, so that the
    sample's balance does not move the scores."""
    rng = np.random.default_rng(conf.seed)
    size = 2 << conf.bits
    vectors = rng.uniform(-1 / conf.width, 1 / conf.width, (size, conf.width)).astype(np.float32)
    out = np.zeros((2, conf.width), np.float32)
    bias = np.zeros(2, np.float32)
    rows = [(b, (c / c.sum()).astype(np.float32), y) for b, c, y in rows if len(b)]
    taken = [sum(y == k for _, _, y in rows) for k in (0, 1)]
    if min(taken) == 0:
        return Model(np.zeros(size), math.log((good + 1) / (bad + 1)))
    steps, done = conf.epochs * len(rows), 0
    for _ in range(conf.epochs):
        for r in rng.permutation(len(rows)):
            b, share, y = rows[r]
            rate = conf.rate * (1 - done / steps)
            mean = share @ vectors[b]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out.T @ p
            out -= (0.05 * rate) * np.outer(p, mean)
            bias -= (0.005 * rate) * p
            vectors[b] -= rate * share[:, None] * back
            done += 1
    shift = math.log((good + 1) / (bad + 1)) - math.log(taken[1] / taken[0])
    return Model((vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]) + shift)


def train(docs: DataFrame, labels: DataFrame, conf: Settings, folds: int = 5, held: int = 0) -> Model:
    """Fit on labelled documents outside the held-out fold.

    At most ``per_class`` rows of each label are taken, in the order of a hash of doc_id; rows with a null or other label count as
    unlabelled, and so does an id with both labels. Of rows that share a labelled id one is read, chosen by a hash of its text. Only hashed counts of the sampled texts reach the driver, at most 2^(bits+1) numbers each.
    """
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(fold(F.col("doc_id"), folds) != held)
    known = known.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("quality").cast("int")).alias("_most"))
    known = known.filter(F.col("quality") == F.col("_most")).drop("_most")
    counts = dict(known.groupBy("quality").count().collect())
    sample = None
    for label in (0, 1):
        part = known.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(conf.per_class)
        sample = part if sample is None else sample.union(part)
    ids = sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = bags(utf8(batch.column(1)), conf)
            columns = [batch.column(0), pa.array([b.astype("<i4").tobytes() for b, _ in found]), pa.array([c.astype("<i4").tobytes() for _, c in found])]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(2)], ["doc_id", "buckets", "counts", "quality"])

    # Broadcast of the sample's ids: two times per_class at most.
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = text.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality")
    chosen = chosen.agg(F.max_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "quality")
    rows = map_arrow(chosen, run, "doc_id long, buckets binary, counts binary, quality int").collect()
    rows.sort(key=lambda r: (r[0], bytes(r[1])))
    rows = [(np.frombuffer(r[1], "<i4"), np.frombuffer(r[2], "<i4"), r[3]) for r in rows]
    return fit(rows, counts.get(1, 0), counts.get(0, 0), conf)


def score_documents(docs: DataFrame, model: Model, conf: Settings, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Score of every row (0 to 1, higher: label 1 likelier) beside the columns ``keep`` (doc_id). An empty or null text gets the
    prior."""
    keep = keep or ["doc_id"]
    weights, bias = model.weights.astype(np.float32), model.bias
    extra = [] if "text" in keep else [F.col("text").cast("string").alias("text")]
    rows = docs.select(*keep, *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, bias)
        for batch in batches:
            scores = own.scores(utf8(batch.column("text").cast(pa.string())), conf)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], [*keep, name])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return map_arrow(rows, run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` double"]))


def keep_good(docs: DataFrame, labels: DataFrame, conf: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """The rows that the classifier does not reject, with all their columns, whatever these are called."""
    plain, own = numbered(docs)
    scored = score_documents(plain, train(docs, labels, conf), conf, plain.columns, "_llm_score")
    return scored.filter(F.col("_llm_score") >= threshold).select(*own)


def classify(docs: DataFrame, labels: DataFrame, conf: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = score_documents(docs, train(docs, labels, conf), conf)
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
