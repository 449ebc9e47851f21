"""Parity of two tables: bucket checksums, drill-down, classification and reports.

Only (bucket, count, checksum) rows leave the first pass. The drill reads the same narrow
fingerprints again, keeps rows of mismatched buckets and aggregates per key, so one hot key or
a heap of equal rows is merged before the shuffle instead of meeting in a join.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinproof.functions.canon import bucket, checksum, key_text, limbs, quoted, row_hash
from twinproof.session import shared_dir
from twinproof.sources.tables import TablePair

BUCKETS = 256
MAX_EXAMPLES = 20
#: Sub-buckets that the second checksum pass makes of each bad bucket.
FANOUT = 64

MISSING, EXTRA, DIFFERENT = "missing_on_target", "extra_on_target", "hash_diff"


def fingerprints(
    pair: TablePair,
    buckets: int = BUCKETS,
    portable: bool = False,
    only: DataFrame | None = None,
    suspects: DataFrame | None = None,
) -> DataFrame:
    """(on_source, b, kh, pk, h) for both sides: key hash, key text and row hash.

    ``only`` (column ``b``, at most one row per bucket) and ``suspects`` (column ``kh``, any
    size) restrict the rows before the row hash and the key text are built.
    """
    if buckets < 1:
        raise ValueError("at least one bucket is needed")
    source, target = pair.sides()

    def side(df: DataFrame, other: DataFrame, on_source: bool) -> DataFrame:
        schema = df.schema
        kh = row_hash(schema, pair.key_columns, other=other.schema, portable=portable)
        keyed = df.withColumn("_kh", kh).withColumn("_b", bucket(F.col("_kh"), buckets))
        if only is not None:
            keyed = keyed.join(only.select(F.col("b").alias("_b")), "_b", "left_semi")
        if suspects is not None:
            keyed = keyed.join(suspects.select(F.col("kh").alias("_kh")), "_kh", "left_semi")
        h = F.col("_kh") if pair.keyless else row_hash(schema, pair.hash_columns, other=other.schema, portable=portable)
        return keyed.select(
            F.lit(on_source).alias("on_source"),
            F.col("_b").alias("b"),
            F.col("_kh").alias("kh"),
            key_text(pair.key_columns, schema).alias("pk"),
            h.alias("h"),
        )

    return side(source, target, True).unionByName(side(target, source, False))


def persist_fingerprints(spark: SparkSession, pair: TablePair, buckets: int = BUCKETS) -> DataFrame:
    """Fingerprints as a table in the shared folder, so that later passes skip the wide scan.

    Three longs and a flag per row; the key text is left out, since a table without a key would
    be written whole.
    """
    path = shared_dir(spark, "fingerprints")
    fingerprints(pair, buckets).drop("pk").write.parquet(path)
    return spark.read.parquet(path)


def _both_sides() -> list[Column]:
    """Row counts and checksums of source and target, as aggregates over fingerprints."""
    src, h = F.col("on_source"), F.col("h")
    return [
        F.count_if(src).alias("source_rows"),
        F.count_if(~src).alias("target_rows"),
        checksum(F.when(src, h)).alias("source_sum"),
        checksum(F.when(~src, h)).alias("target_sum"),
    ]


def _same() -> Column:
    return (F.col("source_rows") == F.col("target_rows")) & (F.col("source_sum") == F.col("target_sum"))


def bucket_sums(prints: DataFrame, by: Iterable[str] = ("b",)) -> DataFrame:
    """Counts and checksums of both sides per bucket."""
    return prints.groupBy(*by).agg(*_both_sides()).withColumn("match", _same())


def bucket_report(pair: TablePair, buckets: int = BUCKETS, portable: bool = False) -> DataFrame:
    """Chunked comparison; a bucket absent on one side counts as zero rows with sum zero."""
    return bucket_sums(fingerprints(pair, buckets, portable))


def full_report(pair: TablePair, portable: bool = False) -> DataFrame:
    """One checksum per side over the whole table; counts alone can also fail it."""
    source, target = pair.sides()

    def side(df: DataFrame, other: DataFrame, on_source: bool) -> DataFrame:
        h = row_hash(df.schema, pair.hash_columns, other=other.schema, portable=portable)
        return df.select(F.lit(on_source).alias("on_source"), h.alias("h"))

    rows = side(source, target, True).unionByName(side(target, source, False))
    totals = rows.agg(*_both_sides())
    # The whole table is bucket 0.
    wrong = F.when(_same(), F.array().cast("array<bigint>")).otherwise(F.array(F.lit(0).cast("bigint")))
    return totals.select(
        F.lit(pair.name).alias("table"), "*", wrong.alias("mismatched_buckets"), _same().alias("match")
    )


def _per_key(prints: DataFrame, by: Iterable[str]) -> DataFrame:
    """Rows and hash sums of both sides per key, kept where they disagree.

    Aggregating both sides together is a full outer join on the key that also copes with
    repeated keys, and merges them before the shuffle.
    """
    src = F.col("on_source")
    signed = [F.sum(F.when(src, limb).otherwise(-limb)) for limb in limbs(F.col("h"))]
    out = prints.groupBy(*by).agg(
        F.count_if(src).alias("source_rows"),
        F.count_if(~src).alias("target_rows"),
        *[column.alias(f"_d{i}") for i, column in enumerate(signed)],
    )
    equal = (F.col("source_rows") == F.col("target_rows")) & (F.col("_d0") == 0) & (F.col("_d1") == 0) & (F.col("_d2") == 0)
    return out.filter(~equal).drop("_d0", "_d1", "_d2")


def suspect_keys(prints: DataFrame) -> DataFrame:
    """Key hashes under which the sides disagree; needs no key text."""
    return _per_key(prints, ["kh"]).select("kh")


def classify(prints: DataFrame, keyless: bool = False) -> DataFrame:
    """Rows that differ, by key: missing, extra or changed.

    Without a key the whole row is the key; then only its number of copies can differ, and the
    side with fewer of them decides.
    """
    ns, nt = F.col("source_rows"), F.col("target_rows")
    if keyless:
        kind = F.when(ns > nt, MISSING).otherwise(EXTRA)
    else:
        kind = F.when(nt == 0, MISSING).when(ns == 0, EXTRA).otherwise(DIFFERENT)
    return _per_key(prints, ["b", "kh", "pk"]).select("b", "pk", "source_rows", "target_rows", kind.alias("kind"))


def drill_prints(prints: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows of mismatched buckets. ``bad`` has at most one row per bucket, so Spark broadcasts it while that is small."""
    return prints.join(bad.filter(~F.col("match")).select("b"), "b", "left_semi")


def drill(pair: TablePair, buckets: int = BUCKETS, portable: bool = False) -> DataFrame:
    """(table, bucket, pk, kind) of every differing row, in one pass over all bad buckets."""
    bad = bucket_report(pair, buckets, portable).filter(~F.col("match"))
    found = classify(fingerprints(pair, buckets, portable, only=bad), pair.keyless)
    return found.select(F.lit(pair.name).alias("table"), F.col("b").alias("bucket"), "pk", "kind")


def refine(prints: DataFrame, bad: DataFrame, fanout: int, buckets: int) -> DataFrame:
    """Second checksum pass inside bad buckets; returns only rows of bad sub-buckets.

    With billions of rows per bucket a single wrong row would otherwise shuffle its whole
    bucket. The refined number is the key hash modulo ``buckets * fanout``.
    """
    fine = drill_prints(prints, bad).withColumn("fine", bucket(F.col("kh"), buckets * fanout))
    wrong = bucket_sums(fine, ["fine"]).filter(~F.col("match")).select("fine")
    return fine.join(wrong, "fine", "left_semi").drop("fine")


def multiset_diff(pair: TablePair) -> DataFrame:
    """Tables without a key: rows whose multiplicity differs, with the surplus on each side."""
    source, target = pair.sides()
    cols = pair.hash_columns
    counted = source.select(*cols, F.lit(1).alias("n")).unionByName(
        target.select(*cols, F.lit(-1).alias("n"))
    )
    return (
        counted.groupBy(*[quoted(c) for c in cols])
        .agg(F.sum("n").alias("surplus"))
        .filter("surplus <> 0")
        .withColumn("kind", F.when(F.col("surplus") > 0, MISSING).otherwise(EXTRA))
        .withColumn("copies", F.abs("surplus"))
        .drop("surplus")
    )


def _all_of(flag: str) -> Column:
    """Verdict over a report with one row per table; such a frame has a handful of rows."""
    return F.bool_and(flag).over(Window.partitionBy())


def summary(
    pairs: Iterable[TablePair],
    ledger_missing: DataFrame | None = None,
    lag: DataFrame | None = None,
    buckets: int = BUCKETS,
    portable: bool = False,
) -> DataFrame:
    """One row per table, plus ``all_match`` over every table and the ledger.

    ``lag`` is a one-row frame with column ``lag``: with changes still in flight, missing rows
    may be false alarms, so the number travels with the report.
    """
    reports = []
    for pair in pairs:
        reports.append(
            bucket_report(pair, buckets, portable)
            .agg(
                F.coalesce(F.sum("source_rows"), F.lit(0)).alias("source_rows"),
                F.coalesce(F.sum("target_rows"), F.lit(0)).alias("target_rows"),
                F.count_if(~F.col("match")).alias("mismatched_buckets"),
            )
            .select(
                F.lit(pair.name).alias("table"),
                F.lit(buckets).cast("bigint").alias("buckets"),
                "source_rows",
                "target_rows",
                "mismatched_buckets",
                (F.col("mismatched_buckets") == 0).alias("match"),
            )
        )
    out = reduce(DataFrame.unionByName, reports)
    ledger_ok = F.lit(True)
    if ledger_missing is not None:
        ledger_ok = ledger_missing.agg((F.count("*") == 0).alias("ok")).scalar()
    out = out.withColumn("ledger_ok", ledger_ok)
    if lag is not None:
        out = out.withColumn("lag", lag.agg(F.max("lag")).scalar())
    return out.withColumn("all_match", _all_of("match") & F.col("ledger_ok"))


def examples(found: DataFrame, limit: int = MAX_EXAMPLES) -> DataFrame:
    """At most ``limit`` examples per table: lower buckets first, source rows before extras.

    This is a top-k report; the complete list is :func:`drill`. Spark prunes each partition to
    ``limit`` rows per table before the shuffle.
    """
    rank = F.when(F.col("kind") == EXTRA, 1).otherwise(0)
    w = Window.partitionBy("table").orderBy("bucket", rank, "pk")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def ledger_missing(ledger: DataFrame, target: DataFrame, id_column: str) -> DataFrame:
    """Ledger ids without a row on the target, compared as text."""
    present = target.select(quoted(id_column).cast("string").alias("id"))
    return ledger.select("id").join(present, "id", "left_anti")


def count_convergence(pairs: Iterable[TablePair]) -> DataFrame:
    """Row counts of both sides per table, and whether every table has converged."""
    counts = []
    for pair in pairs:
        both = pair.source.select(F.lit(1).alias("s")).unionAll(pair.target.select(F.lit(0).alias("s")))
        counts.append(
            both.agg(
                F.count_if(F.col("s") == 1).alias("source_rows"),
                F.count_if(F.col("s") == 0).alias("target_rows"),
            ).withColumn("table", F.lit(pair.name))
        )
    return (
        reduce(DataFrame.unionByName, counts)
        .withColumn("converged", F.col("source_rows") == F.col("target_rows"))
        .select("table", "source_rows", "target_rows", "converged", _all_of("converged").alias("all_converged"))
    )


class Reconciliation(NamedTuple):
    """``report``: a row per table; ``rows``: every differing row; ``examples``: the first of them per table."""

    report: DataFrame
    rows: DataFrame
    examples: DataFrame
    ok: bool


def reconcile(
    spark: SparkSession,
    pairs: Iterable[TablePair],
    *,
    ledger: DataFrame | None = None,
    buckets: int = BUCKETS,
    fanout: int = FANOUT,
    max_examples: int = MAX_EXAMPLES,
    at_once: int = 4,
) -> Reconciliation:
    """The whole job: per-table report, all differing rows, examples, and the overall verdict.

    Fingerprints are written once and narrow, a few tables at a time. The drill compares sub-buckets of the bad buckets and then
    reads only the suspect keys from the tables again. Only the verdict comes to the driver.
    """
    pairs = list(pairs)
    if not pairs:
        raise ValueError("nothing to compare: no table pairs")
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        prints = list(pool.map(lambda pair: persist_fingerprints(spark, pair, buckets), pairs))
    reports, found = [], []
    for pair, p in zip(pairs, prints):
        sums = bucket_sums(p)
        wrong = ~F.col("match")
        reports.append(
            sums.agg(
                F.coalesce(F.sum("source_rows"), F.lit(0)).alias("source_rows"),
                F.coalesce(F.sum("target_rows"), F.lit(0)).alias("target_rows"),
                # At most one number per bucket.
                F.sort_array(F.collect_list(F.when(wrong, F.col("b")))).alias("mismatched_buckets"),
                (F.count_if(wrong) == 0).alias("match"),
            ).select(F.lit(pair.name).alias("table"), F.lit(buckets).alias("buckets"), "source_rows", "target_rows", "mismatched_buckets", "match")
        )
        rows = refine(p, sums, fanout, buckets)
        exact = classify(fingerprints(pair, buckets, suspects=suspect_keys(rows)), pair.keyless)
        found.append(exact.select(F.lit(pair.name).alias("table"), F.col("b").alias("bucket"), "pk", "kind"))
    report = reduce(DataFrame.unionByName, reports)
    rows = reduce(DataFrame.unionByName, found)
    matched = report.agg(F.coalesce(F.bool_and("match"), F.lit(True))).first()[0]
    return Reconciliation(report, rows, examples(rows, max_examples), matched and (ledger is None or ledger.isEmpty()))
