"""Masks and intensities from pixel maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_range(pixels: DataFrame, by: list[str]) -> DataFrame:
    ends = pixels.groupBy(*by).agg(F.min("score").alias("__lo"), F.max("score").alias("__hi"))
    return pixels.join(ends, by)


def binary_mask(pixels: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """``binary`` 255 where an image's min-max score (1e-10 in the denominator) is over the threshold, else 0."""
    scaled = (F.col("score") - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + F.lit(1e-10))
    return _with_range(pixels, by).withColumn("binary", F.when(scaled > threshold, 255).otherwise(0)).drop("__lo", "__hi")


def percentile_mask(pixels: DataFrame, by: list[str], pct: float = 5) -> DataFrame:
    """``binary`` 255 on an image's top ``pct`` per cent (over the interpolated percentile), else 0."""
    limits = pixels.groupBy(*by).agg(F.percentile("score", F.lit(1.0 - pct / 100.0)).alias("__t"))
    return pixels.join(limits, by).withColumn("binary", F.when(F.col("score") > F.col("__t"), 255).otherwise(0)).drop("__t")


def heat_levels(pixels: DataFrame, by: list[str], mode: str = "single_norm") -> DataFrame:
    """``level`` from 0 to 255, scaled per image, or over all maps with ``whole_norm``; constant maps give NULL."""
    if mode == "single_norm":
        met = _with_range(pixels, by)
    else:  # one number each for the lowest and the highest pixel
        lo, hi = pixels.agg(F.min("score"), F.max("score")).first()
        met = pixels.withColumn("__lo", F.lit(lo).cast("double")).withColumn("__hi", F.lit(hi).cast("double"))
    span = F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    return met.withColumn("level", F.floor((F.col("score") - F.col("__lo")) / span * 255).cast("int")).drop("__lo", "__hi")


def binary_mask_packed(maps: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``binary_mask`` of packed maps: adds ``binary``, an array beside ``map``. No shuffle, no row per pixel."""
    ends = maps.withColumn("__lo", F.array_min("map")).withColumn("__hi", F.array_max("map"))
    over = F.expr(f"transform(map, v -> if((v - __lo) / (__hi - __lo + 1e-10D) > {float(threshold)}D, 255, 0))")
    return ends.withColumn("binary", over).drop("__lo", "__hi")


def heat_levels_packed(maps: DataFrame, mode: str = "single_norm") -> DataFrame:
    """``heat_levels`` of packed maps: adds ``level``, an array beside ``map``."""
    if mode == "single_norm":
        met = maps.withColumn("__lo", F.array_min("map")).withColumn("__hi", F.array_max("map"))
    else:  # one number each for the lowest and the highest pixel
        lo, hi = maps.agg(F.min(F.array_min("map")), F.max(F.array_max("map"))).first()
        met = maps.withColumn("__lo", F.lit(lo).cast("double")).withColumn("__hi", F.lit(hi).cast("double"))
    levels = F.expr("transform(map, v -> cast(floor((v - __lo) / nullif(__hi - __lo, 0.0D) * 255) as int))")
    return met.withColumn("level", levels).drop("__lo", "__hi")
