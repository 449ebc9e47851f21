"""Pieces that the operators share: tables, scratch copies, word hashes, salted numbering."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinproof.session import shared_dir

#: White space of every word rule here: U+0020 and U+0009 to U+000D, as ``bytes.split`` has it.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that array code works on at a time, so that a task's memory does not grow with its input.
SLICE = 1 << 20
#: The same for an Arrow batch, of which a task holds several at once: Spark's buffers, the batch, its texts and the answer.
BATCH = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks import it anywhere."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package present on the executors, in batches of about BATCH bytes unless the session has a limit of its own. A worker
    outlives its task, so a task gives back what it has freed."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def saved(df: DataFrame, label: str) -> DataFrame:
    """The frame, written to the shared folder and read again: later steps don't repeat its work."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared folder that nothing reads any more, and what else their jobs left."""
    for path in paths:
        old = spark._jvm.org.apache.hadoop.fs.Path(path)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    forget(spark)


def forget(spark: SparkSession) -> None:
    """Spark deletes the shuffle files and broadcasts of finished jobs once the driver's collector finds their plans unused; ask for
    that between phases. The driver's heap and generated classes shrink with it."""
    gc.collect()
    release()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables of a job's phases: saved, and dropped as soon as later phases don't read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = shared_dir(self.spark, label)
        self.paths.setdefault(label, []).append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Delete all tables of these labels; frames over them can't be read afterwards."""
        delete(self.spark, *(path for label in labels for path in self.paths.pop(label, [])))


def numbered(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The frame with every column but doc_id and text renamed to its number, so that no name clashes with an operator's own, and the columns that give
    the old names back."""
    names = [c if c in ("doc_id", "text") else f"_own_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns)]


def fold(column: Column, parts: int) -> Column:
    """crc32 of a number's decimal text, modulo ``parts``."""
    return F.crc32(column.cast("string").cast("binary")) % parts


def gapless(df: DataFrame, keys: list[str], order: list[str], name: str, rows: int, chunk: int = 10_000) -> DataFrame:
    """Number the rows of each key from 0 without gaps, a hot key's rows in many tasks.

    Rows are dealt into salted chunks of about ``chunk`` rows; each is numbered alone, then moved
    up by the sizes of the chunks before it. ``order`` must tell rows apart; ``rows`` is the row count.
    """
    salts = max(1, math.ceil(rows / chunk))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_salt")
    sizes = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    sizes = sizes.select(*keys, "_salt", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    own = Window.partitionBy(*keys, "_salt").orderBy(*order)
    numbered = salted.withColumn("_row", F.row_number().over(own) - 1)
    return numbered.join(sizes, [*keys, "_salt"]).withColumn(name, (F.col("_before") + F.col("_row")).cast("long")).drop("_salt", "_row", "_before")


class Remembered(dict):
    """Results of a function by argument, in two generations of about ``limit`` entries: what is in use stays."""

    def __init__(self, function: Callable, limit: int):
        super().__init__()
        self.function, self.limit, self.older = function, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


def release() -> None:
    """Give memory that a finished task has freed back to the system: workers live on, and the executor's share is limited."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


# -- Arrow helpers ---------------------------------------------------------------------------------


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives none."""
    return column.fill_null("").cast(pa.binary()).to_pylist()


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array, and where each begins (one more entry for the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer(b"".join(texts), np.uint8), at


def slices(texts: list[bytes], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts have about ``most`` bytes together; a longer text is alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE + 1024)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, _U)
            out[0] = 1
            _powers[name] = np.cumprod(out, dtype=_U)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads each bit over all 64."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end of every white-space-separated word; a text's end ends a word.

    A polynomial in the bytes modulo 2^64, for all words at once: differences of one running sum, divided
    by the power at the word's start. Long inputs are cut at word ends.
    """
    cuts, hashes, starts, ends = np.unique(at), [], [], []
    begin, n = 0, len(data)
    while begin < n:
        stop = min(n, begin + SLICE)
        if stop < n:
            later = int(cuts[np.searchsorted(cuts, stop)])
            while stop < later and not SPACE[data[stop]]:
                stop += 1
        b = data[begin:stop]
        if lower:
            b = LOWER[b]
        inside = ~SPACE[b]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        c = cuts[np.searchsorted(cuts, begin, "right") : np.searchsorted(cuts, stop)] - begin
        first[c] = inside[c]
        last[c - 1] = inside[c - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power(len(b))
        total = np.zeros(len(b) + 1, _U)
        np.cumsum((b.astype(_U) + _U(1)) * up[: len(b)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)))
        starts.append(s + begin)
        ends.append(e + begin)
        begin = stop
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def shingles3(h: np.ndarray) -> np.ndarray:
    """Hash of each window of three consecutive words (two fewer than words)."""
    return mix(mix(mix(h[:-2]) * _U(3) + h[1:-1]) * _U(5) + h[2:])
