"""Connected components of a graph of links, as rounds of joins until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of an edge; a component's id is its smallest node.

    Rounds of the large-star and small-star steps: each node points to the smallest node it
    knows, and its neighbours are handed on, so the rounds grow with the logarithm of the
    longest path. A node with very many links is only ever aggregated, not gathered. Null
    ends are no links; loops and repeated edges do not matter.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    links = cut_lineage(links.filter("u <> v").distinct())
    singles = edges.filter(F.col(a) == F.col(b)).select(F.col(a).alias("node"), F.col(a).alias("component"))
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        next_links = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        links = cut_lineage(next_links.filter("u <> v").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return found.unionByName(singles.join(found, "node", "left_anti")).distinct()
