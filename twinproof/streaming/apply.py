"""Change apply as a stream: landed change files in, an exact table state out.

Each micro-batch is reduced to the latest change per key and written to its own folder, named by run (the stream's
own id) and batch id, so a replayed batch replaces itself and two runs never meet. A generation keeps rows in hash
buckets of the key, each with the position that was applied last, also for deleted keys, and lists the batches it
contains. So a change is judged against its own key's position, however late it lands, and a compaction rewrites only
the buckets that pending changes touch. Nothing rewrites a folder that is being read.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.functions.canon import quoted
from twinproof.operators.changes import DELETE, checked_images, evolve, latest_per_key, route, same_key

#: Columns of a stored row besides its own: bucket, applied position, and whether the key is deleted.
_BUCKET, _POS, _GONE = "_bucket", "_pos", "_gone"


def read_landed(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    *,
    fmt: str = "parquet",
    files: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Stream over landed change files, optionally only those matching a name pattern."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.load(folder)


def read_kafka(spark: SparkSession, servers: str, topics: Sequence[str], **options: str) -> DataFrame:
    """Change topics from Kafka; needs the Spark Kafka package on the class path."""
    return (
        spark.readStream.format("kafka")
        .options(**{"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), **options})
        .load()
    )


def latest_state(changes: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Running latest change per key as a streaming aggregation (use output mode ``update``).

    Partial aggregation runs before the state shuffle, so one busy key costs one row per task.
    """
    return latest_per_key(changes, keys, pos)


@dataclass(frozen=True)
class _Generation:
    """What a manifest says: which folder holds each bucket, which batches are contained."""

    number: int
    folders: dict[int, int]
    batches: frozenset[str]


@dataclass(frozen=True)
class ChangeTable:
    """A keyed table kept as generations plus change batches under one folder.

    ``evolution`` is ``none`` (a batch with unknown columns is rejected) or ``basic`` (columns are added, never dropped or
    retyped). A change is a whole row: a column that its batch lacks becomes null. Positions may be of any type whose order is
    that of the log: numbers, padded text, structs. ``buckets`` is fixed when the table is created. Nulls in a key equal each other.
    With ``history``, batches keep every change instead of the latest per key, so that :meth:`state` can answer for an earlier position.
    """

    path: str
    keys: tuple[str, ...]
    op: str = "op"
    pos: str = "pos"
    evolution: str = "none"
    buckets: int = 32
    history: bool = False

    # -- writing ---------------------------------------------------------------------------

    def create(self, snapshot: DataFrame, high_water, positions: str | None = None) -> None:
        """Generation 0: the initial copy. It contains every change up to ``high_water`` (a value, or a column of no rows'
        content such as a literal struct). ``positions`` names a column with each row's own position, not below that."""
        spark = snapshot.sparkSession
        if self._numbers(spark):
            raise ValueError(f"{self.path} already holds a table")
        mark = F.lit(high_water)
        if isinstance(high_water, int):
            mark = mark.cast("bigint")
        spark.range(1).select(mark.alias(_POS)).write.mode("overwrite").parquet(f"{self.path}/mark")
        own = quoted(positions) if positions else mark
        rows = snapshot.withColumns({_POS: own, _GONE: F.lit(False)})
        if positions:
            rows = rows.drop(positions)
        self._write(rows, 0, {}, frozenset())

    def write_batch(self, batch: DataFrame, batch_id: int, run: str = "direct") -> None:
        """Write the changes of one batch; running it twice for one run and id has no further effect, also after a compaction."""
        name = f"run={run}/batch={batch_id:012d}"
        if name in self._newest(batch.sparkSession).batches:
            return
        if self.evolution == "none":
            known = {*self._rows(batch.sparkSession).columns, self.op, self.pos}
            unknown = sorted(set(batch.columns) - known)
            if unknown:
                raise ValueError(f"batch {batch_id} has unknown columns: {', '.join(unknown)}")
        rows = batch if self.history else latest_per_key(batch, self.keys, self.pos)
        rows.write.mode("overwrite").parquet(f"{self.path}/batches/{name}")

    def start(self, changes: DataFrame, checkpoint: str, mode: str = "append"):
        """Apply everything that has landed, then stop; restarting resumes from the checkpoint.

        Use mode ``update`` for the output of :func:`latest_state`.
        """
        return (
            changes.writeStream.foreachBatch(lambda batch, batch_id: self.write_batch(batch, batch_id, run_name(batch.sparkSession, checkpoint)))
            .outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def compact(self, spark: SparkSession, take_over: bool = False) -> int:
        """Apply the pending batches to the buckets they touch, as a new generation; return its number.

        Each generation is claimed before it is written, so two compactions never write the same one: the second fails. ``take_over``
        repeats a compaction that claimed its generation and was lost.
        """
        now = self._newest(spark)
        names = self._waiting(spark, now)
        latest = self._latest(spark, names)
        if latest is None:
            return now.number
        # One number per bucket at most.
        touched = [r[0] for r in latest.select(self._bucket().alias("b")).distinct().collect()]
        batches = now.batches | frozenset(names)
        if not touched:
            return now.number
        self._claim(spark, now.number + 1, take_over)
        rows = self._merged(self._rows(spark, now, touched), latest)
        self._write(rows, now.number + 1, {b: n for b, n in now.folders.items() if b not in touched}, batches)
        return now.number + 1

    def retire(self, spark: SparkSession) -> list[str]:
        """Delete batches that the newest generation contains, and data that it does not use. Call it while nobody reads an
        older state; returns the deleted folders."""
        now = self._newest(spark)
        gone = [f"batches/{name}" for name in sorted(now.batches)]
        fs, root = self._fs(spark, "data")
        for status in fs.listStatus(root):
            number = int(status.getPath().getName().removeprefix("gen-"))
            used = {b for b, n in now.folders.items() if n == number}
            for part in fs.listStatus(status.getPath()):
                name = part.getPath().getName()
                if name.startswith(f"{_BUCKET}=") and int(name.split("=")[1]) not in used:
                    gone.append(f"data/gen-{number:08d}/{name}")
        out = []
        for relative in gone:
            fs, path = self._fs(spark, relative)
            if fs.exists(path) and fs.delete(path, True):
                out.append(relative)
        return out

    # -- reading ---------------------------------------------------------------------------

    def state(self, spark: SparkSession, as_of=None) -> DataFrame:
        """The table after every change that has been written, or after those up to position ``as_of`` alone.

        An earlier position needs ``history``, and the generations and batches since then: what :meth:`retire` has deleted is an error.
        """
        now = self._newest(spark) if as_of is None else self._before(spark, as_of)
        rows = self._rows(spark, now)
        latest = self._latest(spark, self._waiting(spark, now), as_of)
        if latest is not None:
            rows = self._merged(rows, latest)
        return rows.filter(~F.col(_GONE)).drop(_POS, _GONE)

    # -- rows ------------------------------------------------------------------------------

    def _bucket(self):
        return F.pmod(F.xxhash64(*[quoted(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _merged(self, rows: DataFrame, latest: DataFrame) -> DataFrame:
        """Rows with the changes whose position is beyond that of their key. The rows' payload meets no aggregation."""
        names = [quoted(k) for k in self.keys]
        applied = rows.select(*names, F.col(_POS).alias("_applied")).alias("_a")
        both = latest.alias("_n").join(applied, same_key("_n", "_a", self.keys), "left")
        new = both.filter(F.col("_a._applied").isNull() | (F.col(f"_n.`{self.pos}`") > F.col("_a._applied"))).select("_n.*")
        kept = rows.alias("_r").join(new.select(*names).alias("_k"), same_key("_r", "_k", self.keys), "left_anti")
        new = new.withColumns({_POS: quoted(self.pos), _GONE: F.col(self.op) == DELETE})
        if self.evolution == "basic":
            return evolve(kept, new.drop(*[c for c in (self.op, self.pos) if c not in rows.columns]))
        return kept.unionByName(new.select(*[quoted(c) for c in rows.columns]))

    def _latest(self, spark: SparkSession, names: Sequence[str], as_of=None) -> DataFrame | None:
        """Latest waiting change per key, without those that the snapshot already contains or that came after ``as_of``."""
        if not names:
            return None
        # Only tables that may gain columns pay for reading every footer.
        reader = spark.read.option("mergeSchema", str(self.evolution == "basic").lower())
        waiting = reader.parquet(*[f"{self.path}/batches/{n}" for n in names])
        mark = spark.read.parquet(f"{self.path}/mark").select(_POS).scalar()
        if as_of is not None:
            waiting = waiting.filter(quoted(self.pos) <= F.lit(as_of))
        return latest_per_key(waiting.filter(quoted(self.pos) > mark), self.keys, self.pos)

    def _before(self, spark: SparkSession, as_of) -> _Generation:
        """The newest generation without a change after ``as_of``."""
        if not self.history:
            raise ValueError("only a table with history knows earlier positions")
        newest = self._newest(spark)
        gone = [n for n in newest.batches if not self._exists(spark, f"batches/{n}")]
        for number in reversed(self._numbers(spark)):
            old = self._generation(spark, number)
            folders = [f"data/gen-{n:08d}/{_BUCKET}={b}" for b, n in old.folders.items()]
            if set(gone) <= old.batches and all(self._exists(spark, f) for f in folders):
                if self._rows(spark, old).filter(F.col(_POS) > F.lit(as_of)).isEmpty():
                    return old
        raise ValueError(f"nothing is left to tell the state as of {as_of}")

    # -- folders ---------------------------------------------------------------------------

    def _write(self, rows: DataFrame, number: int, others: dict[int, int], batches: frozenset[str]) -> None:
        """Data first, then the manifest: a generation without a finished manifest does not exist."""
        spark = rows.sparkSession
        folder = f"{self.path}/data/gen-{number:08d}"
        placed = rows.withColumn(_BUCKET, self._bucket())
        # Small buckets share a task and large ones are split, by size.
        placed.hint("rebalance", F.col(_BUCKET)).write.mode("overwrite").partitionBy(_BUCKET).parquet(folder)
        fs, root = self._fs(spark, f"data/gen-{number:08d}")
        own = [p.getPath().getName() for p in fs.listStatus(root)]
        folders = others | {int(n.split("=")[1]): number for n in own if n.startswith(f"{_BUCKET}=")}
        manifest = json.dumps({"folders": folders, "batches": sorted(batches), "schema": rows.schema.json()})
        spark.range(1).select(F.lit(manifest).alias("value")).write.mode("overwrite").text(f"{self.path}/generations/gen-{number:08d}")

    def _claim(self, spark: SparkSession, number: int, take_over: bool) -> None:
        fs, path = self._fs(spark, f"claims/gen-{number:08d}")
        try:
            fs.create(path, take_over).close()
        except Exception as e:
            if fs.exists(path):
                raise RuntimeError(f"generation {number} of {self.path} is being written; take_over=True repeats a lost compaction") from e
            raise

    def _exists(self, spark: SparkSession, relative: str) -> bool:
        fs, path = self._fs(spark, relative)
        return fs.exists(path)

    def _fs(self, spark: SparkSession, relative: str):
        hpath = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{relative}")
        return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath

    def _complete(self, spark: SparkSession, relative: str) -> list[str]:
        """Names of finished folders under one."""
        fs, root = self._fs(spark, relative)
        if not fs.exists(root):
            return []
        folders = [s.getPath() for s in fs.listStatus(root)]
        return sorted(f.getName() for f in folders if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))

    def _numbers(self, spark: SparkSession) -> list[int]:
        return [int(n.removeprefix("gen-")) for n in self._complete(spark, "generations")]

    def _manifest(self, spark: SparkSession, number: int) -> dict:
        """One small file, read without a job."""
        fs, root = self._fs(spark, f"generations/gen-{number:08d}")
        [part] = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("part-") and s.getLen() > 0]
        stream = fs.open(part)
        try:
            return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _newest(self, spark: SparkSession) -> _Generation:
        numbers = self._numbers(spark)
        if not numbers:
            raise ValueError(f"no complete generation under {self.path}")
        return self._generation(spark, numbers[-1])

    def _generation(self, spark: SparkSession, number: int) -> _Generation:
        manifest = self._manifest(spark, number)
        return _Generation(number, {int(b): n for b, n in manifest["folders"].items()}, frozenset(manifest["batches"]))

    def _rows(self, spark: SparkSession, now: _Generation | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """Stored rows of a generation, or of some of its buckets."""
        now = now or self._newest(spark)
        schema = T.StructType.fromJson(json.loads(self._manifest(spark, now.number)["schema"]))
        chosen = {b: n for b, n in now.folders.items() if buckets is None or b in set(buckets)}
        if not chosen:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{self.path}/data/gen-{n:08d}/{_BUCKET}={b}" for b, n in sorted(chosen.items())])

    def _waiting(self, spark: SparkSession, now: _Generation) -> list[str]:
        """Finished batches that the generation does not contain."""
        fs, root = self._fs(spark, "batches")
        if not fs.exists(root):
            return []
        runs = [s.getPath().getName() for s in fs.listStatus(root)]
        return [n for r in runs for b in self._complete(spark, f"batches/{r}") if (n := f"{r}/{b}") not in now.batches]


def run_name(spark: SparkSession, checkpoint: str) -> str:
    """The stream's own id, which its checkpoint holds: a new checkpoint at an old path is another run."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


#: Folder name of changes that belong to no table.
_NOWHERE = "_unrouted"


@dataclass(frozen=True)
class ChangeRouter:
    """One stream of changes of many tables: by topic to its table, the rest to quarantine.

    A change carries ``topic``, ``op``, ``pos`` and the JSON images ``before`` and ``after``. ``schemas`` gives the columns to read
    from the images of each table. A batch is split by one partitioned write, which is deleted once every table has its part. Changes
    that belong to no table or cannot be applied stay in quarantine with their reason, and only they.
    """

    tables: Mapping[str, ChangeTable]
    schemas: Mapping[str, T.StructType]
    quarantine: str
    prefix: str
    segments: int = 1

    def write_batch(self, batch: DataFrame, batch_id: int, run: str = "direct") -> None:
        spark = batch.sparkSession
        name = f"run={run}/batch={batch_id:012d}"
        staged = f"{self.quarantine.rstrip('/')}-staging/{name}"
        routed = route(batch, self.prefix, segments=self.segments, include=list(self.tables))
        part = F.when(F.col("routed"), F.col("table")).otherwise(_NOWHERE)
        routed.withColumn("_part", part).drop("table", "routed").write.mode("overwrite").partitionBy("_part").parquet(staged)
        split = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("_part", T.StringType())])).parquet(staged)
        present = {r[0] for r in split.select("_part").distinct().collect()}  # at most one row per table
        for source in sorted(present):
            mine = split.filter(F.col("_part") == source).drop("_part")
            if source == _NOWHERE:
                bad = mine.withColumn("_reason", F.lit("unrouted"))
            else:
                opened = checked_images(mine, self.schemas[source], self.tables[source].keys)
                good = opened.filter("_reason IS NULL").select("op", "pos", "_image.*")
                self.tables[source].write_batch(good, batch_id, run)
                bad = opened.filter("_reason IS NOT NULL").drop("_image")
            bad.write.mode("overwrite").parquet(f"{self.quarantine}/{name}/source={source}")
        path = spark._jvm.org.apache.hadoop.fs.Path(staged)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def rejected(self, spark: SparkSession, schema: T.StructType, reasons: bool = False) -> DataFrame:
        """Changes that were not applied; ``schema`` is that of the stream. ``reasons`` adds ``source`` (the table, null if none) and ``reason``."""
        fields = [*schema.fields, T.StructField("_reason", T.StringType()), T.StructField("source", T.StringType())]
        found = spark.read.schema(T.StructType(fields)).parquet(self.quarantine)
        if not reasons:
            return found.select(*schema.names)
        return found.select(*schema.names, F.nullif(F.col("source"), F.lit(_NOWHERE)).alias("source"), F.col("_reason").alias("reason"))

    def start(self, changes: DataFrame, checkpoint: str):
        return (
            changes.writeStream.foreachBatch(lambda batch, batch_id: self.write_batch(batch, batch_id, run_name(batch.sparkSession, checkpoint)))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
