"""Parity that is brought forward: the fingerprints of one copy of a table, kept by bucket and changed by its changes.

A store is a log of signed fingerprints: a change takes the old row's print away and adds the new one's, so nothing is rewritten and
a comparison after a day of changes reads no table at all. Bucket sums are kept per batch and add up; they are a row a bucket and batch. Only a drill reads prints, and of
these only the folders of buckets that differ. Both copies need the same keys, columns and types.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.functions.canon import bucket, key_text, limbs, quoted, row_hash
from twinproof.operators.changes import latest_per_key
from twinproof.operators.reconcile import BUCKETS, DIFFERENT, EXTRA, MISSING

_PRINT = ["b", "kh", "pk", "h"]
_SCHEMA = "kh long, pk string, h long, n long, batch long, b long"
_SUMS = "b long, rows long, l0 long, l1 long, l2 long, batch long"


def _weighted() -> list[Column]:
    """Rows and hash limbs, each times the print's sign or count."""
    return [F.sum("n").alias("rows"), *[F.sum(limb * F.col("n")).alias(f"l{i}") for i, limb in enumerate(limbs(F.col("h")))]]


def _total() -> Column:
    weight = lambda bits: F.lit(1 << bits).cast("decimal(14,0)")
    high, middle, low = (F.col(f"l{i}").cast("decimal(20,0)") for i in range(3))
    return (high * weight(42) + middle * weight(21) + low).cast("decimal(38,0)")


@dataclass(frozen=True)
class PrintStore:
    """Fingerprints of one copy below ``path``: ``prints/batch=N/b=K`` and ``sums/batch=N``.

    ``columns`` are the compared ones and include the keys. The first batch is the table itself, number 0.
    """

    path: str
    keys: Sequence[str]
    columns: Sequence[str]
    buckets: int = BUCKETS
    portable: bool = False

    def _prints_of(self, rows: DataFrame) -> DataFrame:
        keys, columns = list(self.keys), list(self.columns)
        kh = row_hash(rows.schema, keys, portable=self.portable)
        return rows.select(
            bucket(kh, self.buckets).alias("b"),
            kh.alias("kh"),
            key_text(keys, rows.schema).alias("pk"),
            row_hash(rows.schema, columns, portable=self.portable).alias("h"),
        )

    def _keys_of(self, rows: DataFrame) -> DataFrame:
        kh = row_hash(rows.schema, list(self.keys), portable=self.portable)
        return rows.select(bucket(kh, self.buckets).alias("b"), kh.alias("kh"), key_text(list(self.keys), rows.schema).alias("pk"))

    def _write(self, spark: SparkSession, delta: DataFrame, batch: int) -> None:
        """Prints first, then their sums from what was written; a batch written again replaces itself."""
        where = f"{self.path}/prints/batch={batch}"
        delta.hint("rebalance", "b").write.mode("overwrite").partitionBy("b").parquet(where)
        written = self._read(spark, "prints", _SCHEMA).filter(F.col("batch") == batch)
        sums = written.groupBy("b").agg(*_weighted())
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sums/batch={batch}")  # a row a bucket

    def _read(self, spark: SparkSession, part: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def create(self, spark: SparkSession, rows: DataFrame) -> None:
        """Fingerprint the whole table, as batch 0. Repeated rows count each time."""
        self._write(spark, self._prints_of(rows).groupBy(*_PRINT).agg(F.count("*").alias("n")), 0)

    def advance(self, spark: SparkSession, changes: DataFrame, batch: int, op: str = "op", pos: str = "pos") -> None:
        """Apply whole-row changes (``d`` deletes, all else upserts), later positions win. Batches count up from 1.

        A batch sees the batches before it only, so that one repeated after a failure gives the same prints. A delete of an absent key changes nothing.
        """
        if batch < 1:
            raise ValueError("batch 0 is the table itself")
        latest = latest_per_key(changes, self.keys, pos)
        new = self._prints_of(latest.filter(~F.col(op).eqNullSafe("d"))).withColumn("n", F.lit(1).cast("bigint"))
        before = self._read(spark, "prints", _SCHEMA).filter(F.col("batch") < batch)
        # A semi join: the changed keys are broadcast while they are few, and then prune the bucket folders too.
        old = before.join(self._keys_of(latest), ["b", "kh", "pk"], "left_semi").select(*_PRINT, (-F.col("n")).alias("n"))
        delta = new.unionByName(old).groupBy(*_PRINT).agg(F.sum("n").alias("n")).filter("n <> 0")
        self._write(spark, delta, batch)

    def prints(self, spark: SparkSession) -> DataFrame:
        """Signed prints of all batches; those of one row add up to its number of copies."""
        return self._read(spark, "prints", _SCHEMA)

    def sums(self, spark: SparkSession) -> DataFrame:
        """Rows and checksum per bucket, from the batches' sums."""
        parts = self._read(spark, "sums", _SUMS).groupBy("b").agg(*[F.sum(c).alias(c) for c in ("rows", "l0", "l1", "l2")])
        return parts.select("b", "rows", _total().alias("sum"))


def compare_sums(spark: SparkSession, source: PrintStore, target: PrintStore) -> DataFrame:
    """The report of ``reconcile.bucket_report`` from kept sums alone."""
    if (list(source.keys), list(source.columns), source.buckets, source.portable) != (list(target.keys), list(target.columns), target.buckets, target.portable):
        raise ValueError("both stores need the same keys, columns, buckets and hash")
    s, t = source.sums(spark).withColumn("s", F.lit(True)), target.sums(spark).withColumn("s", F.lit(False))
    zero = F.lit(0).cast("decimal(38,0)")

    def of(side: Column, value: str, empty: Column) -> Column:
        return F.coalesce(F.max(F.when(side, F.col(value))), empty)

    src, no = F.col("s"), F.lit(0).cast("bigint")
    out = s.unionByName(t).groupBy("b").agg(
        of(src, "rows", no).alias("source_rows"),
        of(~src, "rows", no).alias("target_rows"),
        of(src, "sum", zero).alias("source_sum"),
        of(~src, "sum", zero).alias("target_sum"),
    )
    # A bucket whose rows have all been deleted since is like one that never had any.
    out = out.filter((F.col("source_rows") != 0) | (F.col("target_rows") != 0))
    same = (F.col("source_rows") == F.col("target_rows")) & (F.col("source_sum") == F.col("target_sum"))
    return out.withColumn("match", same)


def drill_stores(spark: SparkSession, source: PrintStore, target: PrintStore) -> DataFrame:
    """(bucket, pk, kind) of every row that differs; the scan skips the folders of buckets that agree."""
    bad = compare_sums(spark, source, target).filter(~F.col("match")).select("b")
    one = source.prints(spark).join(F.broadcast(bad), "b", "left_semi").withColumn("s", F.lit(1).cast("bigint"))  # at most ``buckets`` rows
    two = target.prints(spark).join(F.broadcast(bad), "b", "left_semi").withColumn("s", F.lit(-1).cast("bigint"))
    signed = F.col("n") * F.col("s")
    keys = one.unionByName(two).groupBy("b", "kh", "pk").agg(
        F.sum(F.when(F.col("s") > 0, F.col("n")).otherwise(0)).alias("ns"),
        F.sum(F.when(F.col("s") < 0, F.col("n")).otherwise(0)).alias("nt"),
        *[F.sum(limb * signed).alias(f"d{i}") for i, limb in enumerate(limbs(F.col("h")))],
    )
    equal = (F.col("ns") == F.col("nt")) & (F.col("d0") == 0) & (F.col("d1") == 0) & (F.col("d2") == 0)
    kind = F.when(F.col("nt") == 0, MISSING).when(F.col("ns") == 0, EXTRA).otherwise(DIFFERENT)
    return keys.filter(~equal).select(quoted("b").alias("bucket"), "pk", kind.alias("kind"))
