"""Custom keyed state: the position applied last per key, so that re-delivered changes are dropped before they reach a table.

The state is one position a key, in the RocksDB store of the query's checkpoint, so it survives restarts and lost executors. With a
time to live, keys that saw nothing for that long leave it; a change re-delivered even later is then judged by the table's own
positions, which :class:`~twinproof.streaming.apply.ChangeTable` keeps. The rows of a key pass a task one Arrow batch at a time, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from twinproof.functions.canon import quoted

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestOnly(StatefulProcessor):
    """Of a key's rows in a batch, the one with the highest position, if that is above all positions before."""

    def __init__(self, pos: str, ttl_ms: int | None):
        self.pos, self.ttl_ms = pos, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("pos", T.LongType())])
        self.last = handle.getValueState("last", schema, self.ttl_ms) if self.ttl_ms else handle.getValueState("last", schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        known = self.last.get()
        most = known[0] if known is not None else None
        best = None
        for batch in rows:
            at = batch[self.pos]
            if at.notna().any():
                row = batch.loc[[at.idxmax()]]
                top = int(at.max())
                if most is None or top > most:
                    most, best = top, row
        if best is not None:
            self.last.update((most,))
            yield best

    def close(self) -> None:
        pass


def newest_changes(changes: DataFrame, keys: Sequence[str], pos: str = "pos", ttl_ms: int | None = None) -> DataFrame:
    """The stream of ``changes`` without those at or below their key's last position; at most one a key and batch.

    ``pos`` is a long; a change without one is dropped. Feed the result to a table in mode ``append``. Sets the session's state store to RocksDB.
    """
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return changes.groupBy(*[quoted(k) for k in keys]).transformWithStateInPandas(
        statefulProcessor=NewestOnly(pos, ttl_ms),
        outputStructType=changes.schema,
        outputMode="append",
        timeMode="processingTime" if ttl_ms else "none",
    )
