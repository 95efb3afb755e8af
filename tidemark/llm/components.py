"""Connected components of an edge table by alternating large-star and small-star steps, each step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(edges: DataFrame, work: Workspace, max_rounds: int = 60) -> DataFrame:
    """``node long, component long`` (the smallest node reachable) for every node of ``edges(a long, b long)``.

    Each round joins every node to its smallest neighbour: larger neighbours first (large-star), then smaller ones and itself
    (small-star). Duplicates go in the map-side part of ``distinct``, the smallest neighbour is a plain ``min`` with map-side
    combining, and no neighbour list is ever collected, so a hub costs rows, not memory. It ends when a round changes nothing:
    the edges then are stars around their components' smallest nodes. Nulls and self-loops are ignored.
    """
    now = work.table(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0")
    seen = None
    for k in range(1, max_rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # of rows (node, smaller neighbour): the neighbours and the node go to the node's smallest neighbour
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = work.table(small.where("a <> b").distinct(), f"edges-{k}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        work.drop(f"edges-{k - 2}" if k > 1 else "edges-none")
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
