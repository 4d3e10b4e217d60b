"""Connected components of a graph that no single machine can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) of 64-bit ids -> (node, component): the smallest id that can be reached, for every id that has an edge.

    Each round maps every node to the least of itself and its neighbours and contracts the graph along that map.
    Nodes are ordered by a bijective hash of their ids, so that long ascending chains do not come up and the number of
    edges falls geometrically. Only edges and maps of one round are written; nothing reaches the driver but a count.
    Null ends and loops are ignored.
    """
    left = scratch.keep(
        edges.select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v")).where("a is not null and b is not null and a <> b").distinct(), "edges"
    )
    names = edges.where("a is not null and b is not null and a <> b").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    maps = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "step")
        maps.append(step)
        a, b = step.select("u", F.col("m").alias("mu")), step.select(F.col("u").alias("v"), F.col("m").alias("mv"))
        moved = left.join(a, "u").join(b, "v").where("mu <> mv").select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v"))
        old, left = left, scratch.keep(moved.distinct(), "edges")
        scratch.drop(old)
    found = names.withColumn("label", F.xxhash64("node"))
    for k, step in enumerate(maps):
        step = step.select(F.col("u").alias("label"), F.col("m").alias("to"))
        found = found.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        if k % 6 == 5:
            found = scratch.keep(found, "labels")
    found = scratch.keep(found, "labels")
    least = found.groupBy("label").agg(F.min("node").alias("component"))
    return scratch.keep(found.join(least, "label").select("node", "component"), "components")
