"""Projections, filters and selections on image and patch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.images import is_normal
from .ranking import ranked


def select_categories(df: DataFrame, class_name: str | list[str]) -> DataFrame:
    """One category, a list of them, or all (``'ALL'`` in any case)."""
    names = [class_name] if isinstance(class_name, str) else list(class_name)
    if len(names) == 1 and names[0].upper() == "ALL":
        return df
    return df.where(F.col("category").isin(*names))


def assign_subsets(images: DataFrame, divide_num: int = 1, seed: int = 0) -> DataFrame:
    """``subset`` from 0 to ``divide_num`` - 1: equal parts of each category in an order hashed from id and seed.

    Changes what is scored against what; it is the caller's choice and never made implicitly.
    A category's images are ranked in ranges, so none is sorted in one task.
    """
    if divide_num == 1:
        return images.withColumn("subset", F.lit(0))
    hashed = images.drop("subset").withColumn("__md5", F.md5(F.concat_ws(":", "image_id", F.lit(seed))))
    out = ranked(hashed, ["category"], [F.col("__md5"), F.col("image_id")], "subsets")
    # the first size % divide_num parts have one image more
    at, part, longer = F.col("__rank") - 1, F.floor(F.col("__size") / divide_num), F.col("__size") % divide_num
    inside = at < longer * (part + 1)
    subset = F.when(inside, F.floor(at / (part + 1))).otherwise(longer + F.floor((at - longer * (part + 1)) / F.greatest(part, F.lit(1))))
    return out.withColumn("subset", subset.cast("int")).drop("__md5", "__rank", "__size")


def select_layers(patches: DataFrame, layers: list[int]) -> DataFrame:
    return patches.where(F.col("layer").isin(*layers))


def grid_coords(patches: DataFrame, side: int | None = None, has_cls: bool = False) -> DataFrame:
    """``gy, gx`` of row-major patches on a square grid; with ``has_cls`` row 0 is dropped and the others move up.

    Without ``side`` it is the whole part of the root of the number of patches of an image.
    """
    if has_cls:
        patches = patches.where("patch_id > 0").withColumn("patch_id", F.col("patch_id") - 1)
    if side is None:
        image = Window.partitionBy("image_id", "backbone", "layer")
        width = F.floor(F.sqrt(F.count("*").over(image))).cast("int")
        return patches.withColumn("__side", width).withColumn("gy", F.floor(F.col("patch_id") / F.col("__side")).cast("int")).withColumn("gx", F.col("patch_id") % F.col("__side")).drop("__side")
    return patches.withColumn("gy", F.floor(F.col("patch_id") / side).cast("int")).withColumn("gx", F.col("patch_id") % side)


def drop_normal_types(images: DataFrame) -> DataFrame:
    """Only images of an anomalous folder with an anomalous label."""
    return images.where(~is_normal(F.col("anomaly_type")) & (F.col("is_anomaly") != 0))


def select_pseudo_normal(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The lowest-scoring share of each key's images: a quarter up to 50 images, a fifth up to 100, else 15 %, rounded down; ties by id.

    Ranked in ranges of the scores, so that no task sorts a whole key.
    """
    out = ranked(scores, keys, [F.col("score"), F.col("image_id")], "pseudo-normal-ranks")
    n = F.col("__size")
    share = F.when(n <= 50, F.lit(0.25)).when(n <= 100, F.lit(0.20)).otherwise(F.lit(0.15)).cast("double")
    return out.where(F.col("__rank") <= F.floor(share * n)).drop("__rank", "__size")


def semi_join_reference(patches: DataFrame, selected: DataFrame, on: list[str]) -> DataFrame:
    """The patches of the selected images only."""
    return patches.join(selected.select(*on).distinct(), on, "left_semi")


def union_subsets(parts: list[DataFrame]) -> DataFrame:
    """All subsets' rows under one another, columns matched by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
