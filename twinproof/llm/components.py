"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.common import Scratch


#: Edges that the driver takes (16 bytes each) instead of rounds of jobs.
LOCAL = 1 << 16


def _roots(edges: pa.Table) -> pa.Table:
    """(node, root) of every node of a few edges (u, v)."""
    above: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    for u, v in zip(edges.column("u").to_pylist(), edges.column("v").to_pylist()):
        a, b = find(u), find(v)
        above[max(a, b)] = min(a, b)
    return pa.table({"node": pa.array(above, pa.int64()), "root": pa.array([find(x) for x in list(above)], pa.int64())})


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u > v): each node's neighbours are tied to its smallest one."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.join(least, "u")
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node that it reaches. Loops and repeats are allowed.

    Each round is written to the shared folder, and the round before it is deleted. Rounds end when the edges no longer change, after
    about the logarithm of the longest path. Few edges are joined in the driver.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    scratch = Scratch(edges.sparkSession)
    now, before, turn = scratch.save(now, "edges-0"), None, 0
    if now.limit(LOCAL + 1).count() <= LOCAL:
        known = scratch.save(edges.sparkSession.createDataFrame(_roots(now.toArrow())), "edges-joined")
        scratch.drop("edges-0")
        return known
    while True:
        turn += 1
        now = scratch.save(_stars(_stars(now, True), False), f"edges-{turn}")
        # The exact sum of row hashes tells whether anything changed.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"edges-{turn - 1}")
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
