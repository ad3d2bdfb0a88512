"""Connected components within keys, by alternating large-star and small-star rounds.

A round is a minimum per vertex and one join; no vertex's neighbours are ever gathered in one place, and
each round is written, so lineage stays short. Keys keep graphs apart: all of them are worked off in the same rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored


def _star(edges: DataFrame, keys: list[str], large: bool) -> DataFrame:
    """One round on edges (u, v) with u > v: hang every vertex's larger (or smaller) neighbours on the smallest one."""
    if large:
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("u", "m").alias("m")), "lowest")
        out = both.where("v > u").join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = stored(edges.groupBy(*keys, "u").agg(F.min("v").alias("m")), "lowest")
        out = edges.join(low, [*keys, "u"]).where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(*keys, "u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., u, v``: for each vertex of edges ``keys..., a, b`` that isn't the smallest of its component, that smallest vertex. Keys must not be null."""
    pairs = stored(edges.where("a <> b").select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:  # the number of rounds grows with the logarithm of the number of vertices
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return pairs
        before = now
        pairs = stored(_star(stored(_star(pairs, keys, True), "stars"), keys, False), "stars")
