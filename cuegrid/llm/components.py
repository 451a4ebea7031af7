"""Connected components of an edge table by alternating star contraction.

Each round points every node at the least of its neighbours, by grouped minima and joins; no
neighbourhood is ever gathered into one row or task. Rounds grow with the logarithm of the
longest chain; every round is written, so that lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with b < a. Large star: the greater neighbours of a node join its least one.
    Small star: the lesser neighbours, and the node, do."""
    back = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    near = both.unionByName(back) if large else both
    least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    moved = (back if large else both).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of an edge (a, b), the least node it is connected to."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    size = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    before = size(now)
    while before[0]:
        now = written(_star(_star(now, True), False), "edges")
        after = size(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
