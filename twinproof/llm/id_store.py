"""Token ids in a compressed file format with a shared zstandard dictionary.

Every document is a zstandard frame of its own, so a short one is read without its neighbours; what short frames lack,
statistics of earlier data, comes from a dictionary trained once on serialized id arrays. Frames lie in blocks in ascending
doc_id order. A block carries the dictionary's SHA-256, the first and last doc_id (Parquet skips blocks by them), and the offset
and token count of each of its documents, so its index is read without its frames.

    <path>/dictionary   sha256, bytes of the dictionary, width of an id
    <path>/blocks       shard, block, first_doc, last_doc, before (ids of the shard before it), sha256,
                        doc_ids[], offsets[] (one more for the end), counts[], frames

Files are written by Spark, so a lost executor leaves no half of one.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinproof.llm.common import BATCH, map_arrow, saved, slices, utf8
from twinproof.llm.token_counts import _ODD, _UNIT, _byte_letters
from twinproof.session import shared_dir

#: Frame bytes and documents of a block.
BLOCK_BYTES, BLOCK_DOCS = 256 << 10, 2048
LEVEL = 3


class UnitIds:
    """Ids of texts by the ``tokenizers`` library, which each unit passes once while it is in use.

    For byte-level vocabularies whose word pattern always cuts before a space that a visible character follows: units between
    such places don't affect each other. A word of Latin letters goes to the library's model, which spares it the pattern. All other units
    of some texts that are not known yet pass the library as one text; there a token that begins with a space begins the next unit. A text that may hold a special string goes through the library whole, and so does
    everything if the file has a normalizer or another pattern.
    """

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        before = spec["pre_tokenizer"] or {}
        self.plain = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.spaced = np.zeros(self.library.get_vocab_size(), bool)
        self.letters = str.maketrans({chr(b): c for c, b in _byte_letters().items()})
        self.space = " ".translate(self.letters)
        self.spaced[[i for t, i in self.library.get_vocab().items() if t.startswith(self.space)]] = True
        self.bytes = [i.to_bytes(self.width, "little") for i in range(self.library.get_vocab_size())]
        self.model = self.library.model.tokenize
        self.limit, self.units, self.older, self.tails = limit, {}, {}, {}

    def array(self, text: str) -> np.ndarray:
        [found] = self.library.encode_batch_fast([text], add_special_tokens=False)
        return np.asarray(found.ids, self.kind)

    def encode(self, text: bytes) -> bytes:
        return self.array(text.decode()).tobytes()

    def word(self, letters: bytes) -> bytes:
        """Ids of letters after a space: one word of the pattern, which the library's model takes as it is."""
        shown = letters.decode() if letters.isascii() else letters.decode("latin-1").translate(self.letters)
        return b"".join([self.bytes[t.id] for t in self.model(self.space + shown)])

    def tail(self, marks: bytes) -> bytes:
        """Ids of the marks that end a word."""
        if (known := self.tails.get(marks)) is None:
            if len(self.tails) > 10_000:
                self.tails.clear()
            known = self.tails[marks] = self.encode(marks)
        return known

    def learn(self, units: set[bytes]) -> None:
        """Make sure that the ids of these units, each after a space, are known."""
        if len(self.units) > self.limit:
            self.units, self.older = {}, self.units
        new, known, before, word = [], self.units, self.older.get, self.word
        for u in units.difference(known):
            ids = before(u)
            if ids is None:
                if (letters := u.rstrip(b",.;:!?")).isalpha() or (text := letters.decode()).isalpha() and max(text) < "\u0250":
                    if len(letters) == len(u):
                        ids = word(u)
                    else:
                        ids = (known.get(letters) or before(letters) or word(letters)) + self.tail(u[len(letters) :])
                elif b" " in u:
                    ids = self.encode(b" " + u)
                else:
                    new.append(u)
                    continue
            known[u] = ids
        if new:
            ids = self.array((b" " + b" ".join(new)).decode())
            first = np.flatnonzero(self.spaced[ids])
            if len(first) != len(new):
                raise ValueError("units and their first tokens do not agree")
            at, data = (np.append(first, len(ids)) * self.width).tolist(), ids.tobytes()
            self.units.update(zip(new, map(data.__getitem__, map(slice, at, at[1:]))))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Serialized ids of each text. Units are told apart and put together as Arrow arrays; Python sees each one of a slice once."""
        out: list[bytes] = []
        for i, j in slices(texts, BATCH):
            out += self._slice_ids(texts[i:j])
        return out

    def _slice_ids(self, texts: list[bytes]) -> list[bytes]:
        out, simple, rests, odd, units = [b""] * len(texts), [], [], [], []
        for k, text in enumerate(texts):
            if not self.plain or any(s in text for s in self.specials):
                out[k] = self.encode(text)
            elif _ODD.search(text):
                first, *some = [p.encode() for p in _UNIT.split(text.decode())]
                out[k] = self.encode(first) if first else b""
                odd.append((k, len(some)))
                units += some
            else:
                first, space, rest = text.partition(b" ")
                out[k] = self.encode(first) if first else b""
                if space:
                    simple.append(k)
                    rests.append(rest)
        parts = pc.split_pattern(pa.array(rests, pa.large_binary()), b" ")
        flat = pa.concat_arrays([parts.flatten(), pa.array(units, pa.large_binary())]).dictionary_encode()
        distinct = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(set(distinct))
        found = pa.array(list(map(self.units.__getitem__, distinct)), pa.large_binary()).take(flat.indices)
        at = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, 8 * found.offset)
        data = memoryview(found.buffers()[2] or b"")
        counts = [*pc.list_value_length(parts).to_pylist(), *(n for _, n in odd)]
        ends = at[np.cumsum([0, *counts])].tolist()
        for k, begin, end in zip([*simple, *(k for k, _ in odd)], ends, ends[1:]):
            out[k] += data[begin:end]
        return out


_encoders: dict[str, UnitIds] = {}


def _encoder(path: str) -> UnitIds:
    if path not in _encoders:
        _encoders[path] = UnitIds(path)
    return _encoders[path]


@dataclass
class Store:
    """A written store: its folder, the dictionary and the width of an id."""

    path: str
    dictionary: bytes
    width: int

    @property
    def sha256(self) -> str:
        return hashlib.sha256(self.dictionary).hexdigest()


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT) if data else None


def train_dictionary(docs: DataFrame, path: str, end_id: int, size: int, samples: int, longest: int) -> bytes:
    """A dictionary of at most ``size`` bytes from the id arrays of ``samples`` different whole texts.

    They are the texts of at most ``longest`` characters whose hashes are smallest, so the choice does not depend on the order
    of rows. Too few texts to train on give an empty dictionary: frames then have none.
    """
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.length("text").between(1, longest))
    texts = texts.withColumn("hash", F.xxhash64("text"))
    # Equal texts are neighbours in this order, so a hot one fills only what it has rows for; hashes are read first, alone.
    hashes = texts.select("hash").distinct().orderBy("hash").limit(samples)
    chosen = texts.join(F.broadcast(hashes), "hash").groupBy("hash").agg(F.first("text").alias("text")).orderBy("hash")
    encoder = _encoder(path)
    end = np.asarray([end_id], encoder.kind).tobytes()
    arrays = [ids + end for ids in encoder.ids([r.text.encode() for r in chosen.toLocalIterator()])]
    try:
        return zstandard.train_dictionary(size, arrays, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_store(docs: DataFrame, path: str, end_id: int = 0, dictionary_size: int = 64 << 10, samples: int = 2000, longest: int = 8000) -> Store:
    """Encode every text of ``docs`` (doc_id, text), end each with ``end_id``, and write the store to the shared folder.

    A null or empty text has the end id alone. Equal doc_ids stand side by side in no particular order, null ones first. A very
    long text is a frame like any other, in a block with what came before it. Other columns are not read; an empty table gives a store
    without blocks. Besides the dictionary's sample of texts, bounded by ``samples`` and ``longest``, nothing depends on a part of the rows.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path, end_id, dictionary_size, samples, longest)
    width = _encoder(path).width
    store = Store(shared_dir(spark, "id-store"), dictionary, width)
    spark.createDataFrame([(store.sha256, dictionary, width)], "sha256 string, dictionary binary, width int").coalesce(1).write.parquet(f"{store.path}/dictionary")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = np.asarray([end_id], encoder.kind).tobytes()
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_checksum=True)
        for batch in batches:
            ids, texts = batch.column(0), utf8(batch.column(1))
            for i in range(0, len(texts), 2000):
                arrays = [x + end for x in encoder.ids(texts[i : i + 2000])]
                counts = pa.array([len(a) // width for a in arrays], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(i, 2000), counts, pa.array([squeeze.compress(a) for a in arrays], pa.binary())], ["doc_id", "n", "frame"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    encoded = map_arrow(texts, frames, "doc_id long, n long, frame binary")
    # Written first: the numbers that tell equal doc_ids apart stay, and the range sampling does not encode again.
    encoded = saved(encoded.withColumn("nth", F.monotonically_increasing_id()), "frames")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, nth, before, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple[int | None, int, bytes]] = []

        def block() -> pa.RecordBatch:
            doc, n, parts = zip(*held)
            known = [d for d in doc if d is not None]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).tolist()
            row = {
                "shard": shard, "block": nth, "first_doc": known[0] if known else None, "last_doc": known[-1] if known else None, "before": before,
                "sha256": hashlib.sha256(dictionary).hexdigest(), "doc_ids": list(doc), "offsets": offsets, "counts": list(n), "frames": b"".join(parts),
            }
            return pa.RecordBatch.from_pylist([row], BLOCK_SCHEMA)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "frame"))):
                held.append(row)
                size += len(row[2])
                if size >= BLOCK_BYTES or len(held) >= BLOCK_DOCS:
                    yield block()
                    nth, before, size, held = nth + 1, before + sum(r[1] for r in held), 0, []
        if held:
            yield block()

    ordered = encoded.repartitionByRange("doc_id", "nth").sortWithinPartitions("doc_id", "nth")
    map_arrow(ordered, blocks, BLOCKS).write.option("compression", "uncompressed").parquet(f"{store.path}/blocks")
    return store


BLOCKS = "shard int, block int, first_doc long, last_doc long, before long, sha256 string, doc_ids array<long>, offsets array<long>, counts array<long>, frames binary"
BLOCK_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("before", pa.int64()), ("sha256", pa.string()),
    ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("frames", pa.binary()),
])


def open_store(spark: SparkSession, path: str) -> Store:
    """A store that was written to ``path``; its dictionary must be the one that it names."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    store = Store(path, bytes(row.dictionary), row.width)
    if store.sha256 != row.sha256:
        raise ValueError("the dictionary does not match its hash")
    return store


def _blocks(spark: SparkSession, store: Store) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{store.path}/blocks")


def shard_starts(spark: SparkSession, store: Store) -> DataFrame:
    """(shard, start): ids of all shards before it. One row a written file."""
    sizes = _blocks(spark, store).groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("shard_start"))


def _read(spark: SparkSession, store: Store, rows: DataFrame, wanted: set[int] | None) -> DataFrame:
    """doc_id, start, n_tokens and the ids (little-endian unsigned 32-bit) of the documents in ``rows`` of blocks."""
    dictionary, sha256, kind = store.dictionary, store.sha256, f"<u{store.width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for row in batch.to_pylist():
                if row["sha256"] != sha256:
                    raise ValueError("a block was written with another dictionary")
                out: list[tuple[int | None, int, int, bytes]] = []
                at, held, frames = row["shard_start"] + row["before"], 0, memoryview(row["frames"])
                for i, (doc, n) in enumerate(zip(row["doc_ids"], row["counts"])):
                    if wanted is None or doc in wanted:
                        ids = np.frombuffer(expand.decompress(frames[row["offsets"][i] : row["offsets"][i + 1]]), kind)
                        if len(ids) != n:
                            raise ValueError("a frame does not hold as many ids as its index says")
                        out.append((doc, at, n, ids.astype("<u4").tobytes()))
                        held += 4 * n
                        if held > 4 << 20:
                            yield _documents(out)
                            out, held = [], 0
                    at += n
                if out:
                    yield _documents(out)

    return map_arrow(rows.join(shard_starts(spark, store), "shard"), run, "doc_id long, start long, n_tokens long, ids binary")


def _documents(rows: list[tuple[int | None, int, int, bytes]]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "start", "n_tokens", "ids"])


def read_store(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document."""
    return _read(spark, store, _blocks(spark, store), None)


def read_documents(spark: SparkSession, store: Store, doc_ids: list[int]) -> DataFrame:
    """The same for some documents: only blocks whose range holds one of them are read, and only their frames opened."""
    hit = F.lit(False)
    for d in doc_ids:
        hit = hit | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))
    return _read(spark, store, _blocks(spark, store).filter(hit), set(doc_ids))


def id_facts(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of read documents."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
