"""Initial copy in chunks while the table goes on changing.

A chunk is a range of the key. It is read somewhere between two positions of the log, the ones seen before and after the read, so its rows are
no state of any single position. But a row whose key has no change after the first position is what the log says too, and for
all others the key's latest change is. So a row counts as applied up to its chunk's first position, and changes after it win. A chunk
that fails is read again alone; chunks may come in any order and size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.functions.canon import quoted
from twinproof.streaming.apply import ChangeTable

_LOW, _CHUNK = "_low", "_chunk"


@dataclass(frozen=True)
class ChunkedSnapshot:
    """Chunks of one table below ``path``. ``key`` is the column of the ranges; no row may have it null."""

    path: str
    key: str

    def plan(self, rows: DataFrame, chunks: int) -> int:
        """Cut the key's range at approximate quantiles; returns the number of chunks. The outer ranges are open, so rows that
        come later have a chunk too."""
        if chunks < 1:
            raise ValueError("at least one chunk is needed")
        shares = [i / chunks for i in range(1, chunks)]
        cuts = rows.agg(F.percentile_approx(quoted(self.key), shares or [0.5], 10_000).alias("c")).first()["c"] if shares else None
        cuts = sorted(set(cuts or []))
        kind = rows.schema[self.key].dataType.simpleString()
        bounds = list(zip(range(len(cuts) + 1), [None, *cuts], [*cuts, None]))
        spark = rows.sparkSession
        spark.createDataFrame(bounds, f"chunk int, above {kind}, upto {kind}").coalesce(1).write.parquet(f"{self.path}/plan")
        return len(bounds)

    def read(self, source: DataFrame, chunk: int, low, high) -> None:
        """Copy one chunk of ``source``, read between positions ``low`` and ``high``; a second read replaces the first."""
        spark = source.sparkSession
        if not low <= high:
            raise ValueError("a read ends after it began")
        bound = spark.read.parquet(f"{self.path}/plan").filter(F.col("chunk") == chunk).first()
        if bound is None:
            raise ValueError(f"no chunk {chunk} in the plan")
        rows, key = source, quoted(self.key)
        if bound["above"] is not None:
            rows = rows.filter(key > F.lit(bound["above"]))
        if bound["upto"] is not None:
            rows = rows.filter(key <= F.lit(bound["upto"]))
        rows.withColumn(_LOW, F.lit(low)).write.mode("overwrite").parquet(f"{self.path}/chunks/{_CHUNK}={chunk}")
        marks = spark.createDataFrame([(chunk,)], "chunk int").select("chunk", F.lit(low).alias("low"), F.lit(high).alias("high"))
        marks.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/chunk-{chunk}")

    def waiting(self, spark: SparkSession) -> list[int]:
        """Chunks of the plan that are not read whole yet."""
        planned = [r["chunk"] for r in spark.read.parquet(f"{self.path}/plan").select("chunk").collect()]
        return sorted(c for c in planned if not (self._done(spark, f"chunks/{_CHUNK}={c}") and self._done(spark, f"marks/chunk-{c}")))

    def into(self, spark: SparkSession, table: ChangeTable) -> None:
        """Make the chunks the first generation of a change table; feed it all changes after the least ``low``."""
        left = self.waiting(spark)
        if left:
            raise ValueError(f"chunks not read yet: {', '.join(map(str, left))}")
        least = spark.read.parquet(f"{self.path}/marks/*").agg(F.min("low")).first()[0]
        table.create(spark.read.parquet(f"{self.path}/chunks").drop(_CHUNK), least, positions=_LOW)

    def _done(self, spark: SparkSession, relative: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{relative}/_SUCCESS")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
