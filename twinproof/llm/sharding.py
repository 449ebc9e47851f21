"""Jump consistent hashing: stable keys to shards without a ring table.

Appending a shard moves only the rows that it receives, about 1/(n+1) of all. The key alone decides, so equal
texts under different keys may lie in different shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.common import gapless, map_arrow, mix

_U = np.uint64
#: Stands for a null key.
NULL_KEY = -1


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key, 0 to ``shards`` - 1 (Lamping and Veach, 2014)."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = mix(keys.astype(np.int64).view(_U))
    shard = np.zeros(len(keys), np.int64)
    jump = np.zeros(len(keys), np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        shard[todo] = jump[todo]
        s = state[todo] * _U(2862933555777941757) + _U(1)
        state[todo] = s
        jump[todo] = ((shard[todo] + 1) * (float(1 << 31) / ((s >> _U(33)).astype(np.float64) + 1.0))).astype(np.int64)
        todo = todo[jump[todo] < shards]
    return shard


def assign(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """Add ``shard`` and ``grown_shard`` (with one shard more) in place of columns so named; every other column stays.

    The key is a long. Null keys share one shard; repeated rows go to the same one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(key).fill_null(NULL_KEY).to_numpy(zero_copy_only=False)
            out = [pa.array(jump_hash(keys, n), pa.int32()) for n in (shards, shards + 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "shard", "grown_shard"])

    clean = docs.drop("shard", "grown_shard").withColumn(key, F.col(key).cast("long"))
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema.fields)
    return map_arrow(clean, run, own + ", shard int, grown_shard int")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    Slots number each shard's rows from 0 without gaps, in an order that holds no meaning. A null text has
    size 8 and the checksum of no bytes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = docs.count()
    out = gapless(assign(narrow, shards), ["shard"], ["doc_id", "size", "text_crc32"], "slot", rows)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
