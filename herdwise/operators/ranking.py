"""Positions in a sort order within keys, in two levels, so that no task sorts a whole key.

Rows are dealt into ranges of the order, written once, and counted per range; the counts (one
number per key and range) give each range its offset, and the rest is local to a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def in_ranges(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``__r``, a range of rows that are neighbours by key and order. Range bounds are sampled, so a large key gets many ranges."""
    return stored(df.repartitionByRange(*keys, *order).withColumn("__r", F.spark_partition_id()), name)


def running_sums(ranged: DataFrame, keys: list[str], order: list[Column], sums: dict[str, tuple[str, str]]) -> DataFrame:
    """For each ``column: (running, total)`` of ``sums`` adds the sum of ``column`` over the key's rows up to this one, and over all of them. Rows that tie must not matter."""
    totals = ranged.groupBy(*keys, "__r").agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    every = Window.partitionBy(*keys)
    before = every.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__r", *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums), *(F.sum(f"__{c}").over(every).alias(t) for c, (_, t) in sums.items()))
    same = F.lit(True)
    for k in [*keys, "__r"]:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    met = ranged.alias("a").join(offsets.alias("b"), same).select("a.*", *(f"b.{x}" for c, (_, t) in sums.items() for x in (f"__{c}", t)))
    running = Window.partitionBy(*keys, "__r").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumns({r: F.sum(c).over(running) + F.col(f"__{c}") for c, (r, _) in sums.items()}).drop("__r", *(f"__{c}" for c in sums))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``__rank`` from 1 within each key and ``__size``, the key's number of rows."""
    ranged = in_ranges(df.withColumn("__1", F.lit(1)), keys, order, name)
    return running_sums(ranged, keys, order, {"__1": ("__rank", "__size")}).drop("__1")
