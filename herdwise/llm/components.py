"""Connected components of an edge table, by alternating large-star and small-star rounds.

No vertex's neighbours are ever gathered in one place: a round is a minimum per
vertex (combined before the shuffle and written) and one join, both of whose sides are then
plain shuffles: a vertex with a third of all edges is a skewed key that adaptive execution splits.
Each round is written to the shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round on edges (u, v) with u > v: hang every vertex's larger (or smaller) neighbours on the smallest one."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = common.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = common.stored(edges.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        out = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every vertex that has an edge to another one; the root is the smallest vertex of the component."""
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    since = common.mark()
    pairs, before = common.stored(pairs, "edges"), None
    while True:  # the number of rounds grows with the logarithm of the number of vertices
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        larger = common.stored(_star(pairs, True), "stars")
        pairs = common.stored(_star(larger, False), "stars")
        common.release(edges.sparkSession, since, keep=1)  # of a round only its result is read again
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
