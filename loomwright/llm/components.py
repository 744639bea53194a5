"""Connected components of an edge table by alternating large-star and small-star rounds.

Kiveris et al., "Connected components in MapReduce and beyond" (2014).  Every round is two minima per node and two
joins; a hub's neighbours never meet in one task.  Rounds are cut by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), undirected and without loops -> the same components, each node tied to a smaller one."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.filter("v > u")
    else:
        moved = both.filter("v < u")
        least = moved.groupBy("u").agg(F.min("v").alias("m"))
    out = moved.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u long, v long) -> (node, component) for every node of an edge; component is the smallest node."""
    now = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "links")
    state = None
    for _ in range(max_rounds):
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if seen == state or not seen["n"]:
            break
        state = seen
        before, now = now, durable(_star(_star(now, True), False), "stars")
        discard(before)
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
