"""Connected components by alternating star operations on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.session import stage

MAX_ROUNDS = 60


def _smallest(edges: DataFrame) -> DataFrame:
    """``u, v, m`` with the smallest neighbour of ``u`` beside each of its edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node with an edge; ``root`` is the smallest node of its component.

    ``edges`` holds pairs of long ids in its first two columns, in any
    direction and with repeats; loops are ignored. Each round links all larger
    neighbours of a node, then all smaller ones, to the smallest; rounds are
    written down, so that the plan doesn't grow and lost executors cost
    one round at most. Hot nodes are pre-aggregated and their joins can be split.
    """
    a, b = edges.columns[:2]
    e = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, before = stage(e, "edges"), None
    for _ in range(MAX_ROUNDS):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        small = _smallest(large)
        small = small.select("u", F.col("m").alias("v")).union(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        e = stage(small, "edges")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
