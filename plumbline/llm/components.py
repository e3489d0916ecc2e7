"""Connected components of a link table, by contraction in the shared folder.

Each round every node joins one neighbour of lower random rank, chains are
shortened by two joins, and links move to the nodes that are left.  The random
rank makes chains short whatever the ids are.  The smallest id of each
component is found by grouping at the end.  Once no more than FEW links are
left, one task finishes them.  No links go to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordering import stage_table

FEW = 20_000


def lowest_members(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each node 0..n-1 under links a-b, by propagation and jumping."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _finish(links: pa.Table) -> pa.Table:
    a, b = links.column("a").to_numpy(), links.column("b").to_numpy()
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    return pa.table({"node": pa.array(nodes), "up": pa.array(nodes[lowest_members(len(nodes), flat[: len(a)], flat[len(a):])])})


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for all nodes of ``links`` (a, b); component is the smallest node reachable.

    Nodes are long integers.  Links from a node to itself, null ends and repeated links are harmless.
    """
    spark = links.sparkSession
    level = stage_table(links.where("a is not null and b is not null").select("a", "b").distinct())
    ends = level.select(F.col("a").alias("node")).unionByName(level.select(F.col("b").alias("node"))).distinct()
    steps, left, turn = [], level.where("a <> b"), 0
    while (n := left.count()) > 0:
        if n <= FEW:
            steps.append(stage_table(left.withColumn("all", F.lit("")).groupBy("all").applyInArrow(_finish, "node long, up long")))
            break

        def rank(c, turn=turn):
            return F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("r"), F.col(c).alias("id"))

        both = left.select(F.col("a").alias("node"), "b").unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("b")))
        lowest = both.groupBy("node").agg(F.min(rank("b")).alias("low"))
        up = stage_table(lowest.select("node", F.when(F.col("low") < rank("node"), F.col("low.id"))
                                       .otherwise(F.col("node")).alias("up")))
        for _ in range(2):
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = up.join(above, "up").select("node", F.col("top").alias("up"))
        up = stage_table(up)
        steps.append(up)
        for end in ("a", "b"):
            left = left.join(up.select(F.col("node").alias(end), "up"), end).drop(end).withColumnRenamed("up", end)
        left = stage_table(left.where("a <> b").select("a", "b").distinct())
        turn += 1
    found = ends.withColumn("root", F.col("node"))
    for up in steps:
        found = (found.join(up.select(F.col("node").alias("root"), "up"), "root", "left")
                 .select("node", F.coalesce("up", "root").alias("root")))
    found = stage_table(found)
    lowest = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(lowest, "root").select("node", "component")
