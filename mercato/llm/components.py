"""Connected components of a link table by alternating star joins.

Large-star connects every node's larger neighbours to the smallest node of
its neighbourhood, small-star its smaller ones; both keep the components, and
repeated they end in stars around each component's smallest node after a
number of rounds that grows with the logarithm of the component size.  All
of it is aggregates and equi-joins on the node, written to the checkpoint
folder after every round; neighbour lists are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written before it is joined back, so that adaptive execution can split the join at a hub
    low = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-low")
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = store(edges.groupBy("u").agg(F.min("v").alias("m")), "star-low")
    moved = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of the links; the component is its smallest node."""
    edges = store(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                  .filter("u > v").distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = store(_small_star(store(_large_star(edges), "stars-large")), "stars")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
