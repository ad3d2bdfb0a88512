"""Image records from a dataset tree ``<category>/.../<anomaly_type>/<name>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of normal images (fixed values).
NORMAL_TYPES = ("good", "Normal", "ok")


def with_path_parts(df: DataFrame, path: str = "path", depth: int = 4) -> DataFrame:
    """Adds ``category, split, anomaly_type, img_name, is_anomaly``, read off the last parts of a path.

    ``depth`` is the number of parts from the category on: 4 for
    ``category/test/good/0.png``, 5 for ``category/Data/Images/Normal/0.png``. Folders that
    Spark has partitioned by name (``category=bottle``) count by their value.
    """
    parts = F.split(F.col(path), "/")
    part = lambda i: F.regexp_replace(F.try_element_at(parts, F.lit(i)), "^[a-z_]+=", "")
    kind = part(-2)
    return df.withColumns({"category": part(-depth), "split": part(1 - depth), "anomaly_type": kind, "img_name": part(-1), "is_anomaly": (~kind.isin(*NORMAL_TYPES)).cast("int")})


def image_inventory(spark: SparkSession, root: str, depth: int = 4, pattern: str = "*.png") -> DataFrame:
    """``path, bytes`` and the parts of every image under ``root``. Only the listing is read, not the images."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return with_path_parts(files.select("path", F.col("length").alias("bytes")), "path", depth)


def is_normal(anomaly_type: Column) -> Column:
    return anomaly_type.isin(*NORMAL_TYPES)
