"""Order in which tables can be loaded so that parents come before children.

Levels are found by peeling: a round places every table whose parents are all placed. What is never placed hangs on a cycle;
peeling that from the other end tells the cycles from what waits behind them. A round is one aggregation over the edges, written to the
shared folder, so lineage does not grow with the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from twinproof.session import shared_dir

ORDERED, CYCLE, BEHIND = "ordered", "cycle", "behind a cycle"


def _peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): 0 for nodes that need none, then one more than the highest level needed; null where that never ends.

    ``edges``: (node, needs), distinct and among the nodes.
    """
    spark = nodes.sparkSession
    now = nodes.join(edges.select("node").distinct(), "node", "left_semi").select("node", F.lit(None).cast("int").alias("level"))
    now = now.unionByName(nodes.join(edges, "node", "left_anti").select("node", F.lit(0).alias("level")))
    placed = -1
    while True:
        seen, path = Observation(), shared_dir(spark, "levels")
        now.observe(seen, F.count("level").alias("placed")).write.parquet(path)
        now = spark.read.schema("node string, level int").parquet(path)
        if seen.get["placed"] == placed:
            return now
        placed = seen.get["placed"]
        needed = edges.join(now.select(F.col("node").alias("needs"), "level"), "needs")
        # A level is known once all that it needs have one; the maximum alone would skip the unknown.
        known = F.when(F.count("level") == F.count("*"), F.max("level") + 1)
        now = now.select("node", F.col("level").alias("_was")).join(needed.groupBy("node").agg(known.alias("_new")), "node", "left")
        now = now.select("node", F.coalesce("_was", "_new").alias("level"))


def load_order(tables: DataFrame, references: DataFrame) -> DataFrame:
    """table, level and state of every table in ``tables`` (table).

    ``references``: (child, parent), in any number; a table's reference to itself and references to other tables than these need no
    order. Level 0 loads first. State ``cycle`` is on a cycle, or between two; ``behind a cycle`` needs one of those. Neither has a level:
    there the keys have to be checked after the load (see ``orphan_rows``).
    """
    spark = tables.sparkSession
    path = shared_dir(spark, "references")
    nodes = tables.select(F.col("table").cast("string").alias("node")).distinct()
    edges = references.select(F.col("child").cast("string").alias("node"), F.col("parent").cast("string").alias("needs")).filter("node <> needs").distinct()
    edges = edges.join(nodes, "node", "left_semi").join(nodes.select(F.col("node").alias("needs")), "needs", "left_semi")
    edges.select("node", "needs").write.parquet(path)
    edges = spark.read.schema("node string, needs string").parquet(path)
    levels = _peeled(nodes, edges)
    left = levels.filter("level IS NULL").select("node")
    inside = edges.join(left, "node", "left_semi").join(left.select(F.col("node").alias("needs")), "needs", "left_semi")
    behind = _peeled(left, inside.select(F.col("needs").alias("node"), F.col("node").alias("needs")))
    state = F.when(F.col("level").isNotNull(), ORDERED).when(F.col("_back").isNull(), CYCLE).otherwise(BEHIND)
    out = levels.join(behind.select("node", F.col("level").alias("_back")), "node", "left")
    return out.select(F.col("node").alias("table"), "level", state.alias("state"))
