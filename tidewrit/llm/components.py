"""Connected components by alternating large and small stars, with all state in tables.

Each round is two joins on the node; every node's edges are pre-aggregated to their minimum before the shuffle, and no
adjacency list is gathered. The minima are written before they are joined, so a join has nothing but a shuffle below it
on either side and Spark can split the partition of a hub. Rounds grow with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _with_least(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """edges (u, v) with m, the least neighbour of u; and the table of these."""
    least = scratch.keep(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    return edges.join(least, "u"), least


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Of links (u, v): each node that is not the least of its component, with the least as root.

    Null ends and loops are left out. Returns (node, root), kept in scratch. The number of rounds is bounded only as a
    guard against a defect: 60 rounds suffice for components of any size that fits into storage.
    """
    links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    links, state = scratch.keep(links, "links"), None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, first = _with_least(both, scratch)
        large = scratch.keep(large.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct(), "large")
        small, second = _with_least(large, scratch)
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        new = scratch.keep(small, "links")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(links, first, large, second)
        links = new
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError(f"components: no end after {most_rounds} rounds")
