"""Image, patch and pixel tables derived from the given tables, so that every query's work grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select(F.col("vec_id").cast("long").alias("image_id"), F.concat(F.lit("c"), "label").alias("category"), F.col("embedding").cast("array<double>").alias("e"))


def images(spark: SparkSession, sf: str) -> DataFrame:
    e = _embeddings(spark, sf).drop("e")
    bad = (F.col("image_id") % 4 == 0).cast("int")
    kind = F.when(F.col("is_anomaly") == 1, F.concat(F.lit("defect_"), F.col("image_id") % 3)).otherwise("good")
    e = e.withColumn("subset", F.lit(0)).withColumn("is_anomaly", bad).withColumn("anomaly_type", kind).withColumn("img_name", F.concat("image_id", F.lit(".png")))
    return e.withColumn("path", F.concat_ws("/", F.lit("data"), "category", F.lit("test"), "anomaly_type", "img_name"))


def patches(spark: SparkSession, sf: str, backbone: int = 1, layers: tuple[int, ...] = (0, 1)) -> DataFrame:
    """A 4 x 4 grid of 4-channel patches; layer 1 is the vector backwards, backbone 2 has the vector's halves swapped."""
    e = _embeddings(spark, sf)
    v = F.col("e") if backbone == 1 else F.concat(F.slice("e", 33, 32), F.slice("e", 1, 32))
    by_layer = F.array(*(F.struct(F.lit(layer).alias("layer"), (v if layer == 0 else F.reverse(v)).alias("v")) for layer in layers))
    e = e.select("category", F.lit(0).alias("subset"), "image_id", F.lit(backbone).alias("backbone"), F.explode(by_layer).alias("l"))
    e = e.select("category", "subset", "image_id", "backbone", "l.layer", F.col("l.v").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("patch_id"))
    return e.select("category", "subset", "image_id", "backbone", "layer", "patch_id", F.floor(F.col("patch_id") / 4).cast("int").alias("gy"), (F.col("patch_id") % 4).alias("gx"), F.slice("v", F.col("patch_id") * 4 + 1, 4).alias("feat"))


def image_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _embeddings(spark, sf).select("category", "image_id", F.col("e").alias("vec"))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """8 x 8 maps, masked where the next image's vector is over 0.15; the last image has no next one and is left out."""
    e = _embeddings(spark, sf)
    after = e.select((F.col("image_id") - 1).alias("image_id"), F.col("e").alias("e2"))
    at = e.join(after, "image_id").select("category", "image_id", F.posexplode(F.arrays_zip("e", "e2")).alias("pos", "z"))
    return at.select("category", "image_id", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), F.col("z.e").alias("score"), (F.col("z.e2") > 0.15).cast("int").alias("mask"))


def maps(spark: SparkSession, sf: str) -> DataFrame:
    """``pixels`` as they are packed, a row per image: ``category, image_id, map, mask``."""
    e = _embeddings(spark, sf)
    after = e.select((F.col("image_id") - 1).alias("image_id"), F.col("e").alias("e2"))
    return e.join(after, "image_id").select("category", "image_id", F.col("e").alias("map"), F.transform("e2", lambda v: (v > 0.15).cast("int")).alias("mask"))


def image_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = _embeddings(spark, sf)
    return e.select("category", "image_id", F.array_max("e").alias("score"), (F.col("image_id") % 4 == 0).cast("int").alias("is_anomaly"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("event_type").alias("grp"), F.col("value").cast("double").alias("score"), (F.col("user_id") % 5 == 0).cast("int").alias("label"), (F.col("user_id") % 3 == 0).cast("int").alias("label3"))


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/lineitem.parquet")
    return e.select(F.col("l_linestatus").alias("grp"), F.col("l_extendedprice").cast("double").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
