"""Connected components by alternating star contraction; links and labels stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealroute.llm.common import keep


def _toward_smallest(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _flatten(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    smallest = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(smallest.withColumnRenamed("m", "v")).distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, root) of every node with a link; the root is the smallest node of the component.

    ``links`` has the columns u and v of one orderable type; direction, repeated links and loops do not matter. Each
    round writes its links to ``folder``; rounds grow with the logarithm of the longest chain.
    """
    current = keep(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                   folder, "links-0")
    state, step = None, 0
    while True:
        marks = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if marks == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state, step = marks, step + 1
        current = keep(_flatten(_toward_smallest(current)), folder, f"links-{step}")
