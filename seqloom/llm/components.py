"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import saved


def connected(links: DataFrame, folder: str, name: str) -> DataFrame:
    """node, component (a node of it) for every node of links (a, b).

    Each round hooks every node to the least of itself and its neighbours, follows the pointers twice, and
    draws the links again between the pointers' ends; chains of pointers get shorter by a constant factor
    because nodes are digests, in random order. Rounds end when no link is left between different ends; the
    rounds' pointers composed are the components. Every step is a join or aggregation by node.
    """
    edges, hops, k = saved(links.where("a <> b").select("a", "b").distinct(), folder, f"{name}-edges0"), [], 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("to"))
        up = saved(up, folder, f"{name}-up{k}")
        for step in range(2):
            then = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
            up = saved(up.join(then, "to").select("node", F.col("next").alias("to")), folder, f"{name}-up{k}-{step}")
        hops.append(up)
        for side in ("a", "b"):
            edges = edges.join(up.withColumnRenamed("node", side), side).drop(side).withColumnRenamed("to", side)
        k += 1
        edges = saved(edges.where("a <> b").select("a", "b").distinct(), folder, f"{name}-edges{k}")
    if not hops:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = hops[0].withColumnRenamed("to", "component")
    for up in hops[1:]:
        out = out.join(up.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return saved(out, folder, f"{name}-components")
