"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import saved


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of ``edges`` with the smallest node that it reaches.

    ``edges`` has two columns of one orderable type. Null ends, loops and repeated edges
    are ignored; a node that only has a loop is kept as its own component. An empty table
    gives an empty table. Each round replaces edges by edges to a smaller neighbour:
    minima are combined on the map side, and they are saved before the join so that a
    hub's edges meet them in a plain shuffle join, which AQE can split.
    The number of rounds is logarithmic in the number of nodes.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    ends = saved(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    loops = ends.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    links = ends.where("u <> v")
    for _ in range(max_rounds):
        # done when all edges form stars: no node has two smaller neighbours, or one and a larger one
        roles = links.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(links.select("v", F.lit(0), F.lit(1)))
        if roles.groupBy("x").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 OR (c = 1 AND p = 1)").isEmpty():
            break
        both = links.union(links.select("v", "u"))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-min")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large, "cc-large")
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = saved(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.union(roots).union(loops).groupBy("node").agg(F.min("component").alias("component"))
