"""One query per operator of the inventory, on tables derived from the given ones. Floats are rounded last, to six digits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import graph, local, maps, metrics, neighbors, oneclass, scoring, selection
from ..sources import features, images, scratch, sinks
from . import fixtures as fx
from . import pipelines

KEYS = ["category", "subset", "layer"]
IMAGE = [*KEYS, "image_id"]
SIZE = 8
R_LIST = [1, 3, 5]
DIGITS = 9
#: Fixed channel constants for the query of channel_standardize.
MEAN, STD = [0.48, 0.45, 0.40, 0.5], [0.27, 0.26, 0.28, 0.25]


def r6(df: DataFrame, *columns: str) -> DataFrame:
    # adding 0.0 turns a negative zero into zero
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def feat6(df: DataFrame, c: str = "feat") -> DataFrame:
    """A vector as rounded text: the same in any engine."""
    return df.withColumn(c, F.array_join(F.transform(F.col(c), lambda x: F.format_string("%.6f", F.round(x, 6) + F.lit(0.0))), " "))


def unit_patches(spark: SparkSession, sf: str, backbone: int = 1, layers: tuple[int, ...] = (0,)) -> DataFrame:
    return fx.patches(spark, sf, backbone, layers).withColumn("feat", V.l2_normalized(F.col("feat")))


def references(spark: SparkSession, sf: str) -> DataFrame:
    return selection.select_pseudo_normal(fx.image_scores(spark, sf), ["category"]).select("category", "image_id")


def ref_patches(spark: SparkSession, sf: str, backbone: int) -> DataFrame:
    return selection.semi_join_reference(unit_patches(spark, sf, backbone), references(spark, sf), ["category", "image_id"])


def mutual(spark: SparkSession, sf: str, layers: tuple[int, ...] = (0,)) -> DataFrame:
    return scoring.mutual_score(unit_patches(spark, sf, 1, layers), KEYS)


def training_pairs(spark: SparkSession, sf: str) -> DataFrame:
    r1, r2 = ref_patches(spark, sf, 1), ref_patches(spark, sf, 2)
    return neighbors.fuser_training_pairs(r1, r2, KEYS)


def backbone_means(spark: SparkSession, sf: str) -> DataFrame:
    on = [*IMAGE, "patch_id"]
    s = [scoring.reference_score(unit_patches(spark, sf, b), ref_patches(spark, sf, b), KEYS) for b in (1, 2)]
    return scoring.join_backbones(*s, on)


def graph_edges(spark: SparkSession, sf: str, k: int = 3) -> DataFrame:
    return graph.top_k_neighbors_blocked(fx.image_vectors(spark, sf), k, ["category"], DIGITS)


def grid_scores(spark: SparkSession, sf: str) -> DataFrame:
    return selection.grid_coords(mutual(spark, sf), 4)


def q_image_inventory(spark, sf):
    """Writes the images as a tree of files, one each, and takes the inventory of that."""
    path = scratch.new_path(spark, "tree")
    named = fx.images(spark, sf).select("category", F.lit("test").alias("split"), "anomaly_type", "img_name")
    named.repartition("category", "anomaly_type").write.option("maxRecordsPerFile", 1).partitionBy("category", "split", "anomaly_type").text(path)
    found = images.image_inventory(spark, path, pattern="*.txt")
    return found.groupBy("category", "split", "anomaly_type", "is_anomaly").agg(F.count("*").alias("images"), F.sum("bytes").alias("bytes"))


class HalvesExtractor:
    """A stand-in for a backbone: layer 0 is the vector cut into patches of four, layer 1 the same of the vector backwards; the image vector is the mean of the patches."""

    def __call__(self, batch: list) -> dict[int | str, np.ndarray]:
        x = np.stack([np.asarray(v, float) for v in batch])
        cut = x.reshape(len(x), -1, 4)
        return {0: cut, 1: x[:, ::-1].reshape(len(x), -1, 4), features.IMAGE: cut.mean(1)}


def q_extract_features(spark, sf):
    """Patch vectors, and the image vectors as layer and patch -1."""
    got = scratch.stored(features.extract(fx.image_vectors(spark, sf), HalvesExtractor, [0, 1], "vec", ["category", "image_id"]), "extracted")
    vectors = features.image_vectors(got).select("category", "image_id", "backbone", F.lit(-1).alias("layer"), F.lit(-1).alias("patch_id"), F.col("vec").alias("feat"))
    return feat6(features.patch_features(got).unionByName(vectors))


def q_consolidate_class_features(spark, sf):
    v = fx.image_vectors(spark, sf).withColumn("item", (F.col("image_id") % 2).cast("int"))
    name = F.when(F.col("image_id") % 5 == 0, "mvtec_ad_cls.dat").when(F.col("image_id") % 7 == 0, F.concat(F.lit("visa_"), "category", F.lit(".dat"))).otherwise(F.concat(F.lit("mvtec_ad_"), "category", F.lit(".dat")))
    files, store = scratch.new_path(spark, "feature-files"), scratch.new_path(spark, "store")
    v.select("item", "image_id", "vec", name.alias("file_name")).write.partitionBy("file_name").parquet(files)
    features.write_class_store(features.consolidate_class_features(features.read_class_features(spark, files), "mvtec"), store)
    return feat6(features.read_class_store(spark, store), "vec")


def q_write_report(spark, sf):
    path = scratch.new_path(spark, "report")
    sinks.write_report(q_evaluate(spark, sf), path)
    return spark.read.schema("category string, " + ", ".join(f"{c} double" for c in sinks.REPORT_COLUMNS[1:])).option("header", "true").csv(path)


def q_write_maps(spark, sf):
    kinds = fx.images(spark, sf).select("image_id", "anomaly_type")
    path = scratch.new_path(spark, "maps")
    sinks.write_maps(maps.binary_mask(fx.pixels(spark, sf), ["image_id"]).join(kinds, "image_id").select("category", "anomaly_type", "image_id", "y", "x", "binary"), path)
    return spark.read.parquet(path).groupBy("category", "anomaly_type").agg(F.count("*").alias("pixels"), F.sum("binary").alias("total"))


def q_select_categories(spark, sf):
    return selection.select_categories(fx.images(spark, sf), ["c1", "c3"]).select("category", "image_id", "path")


def q_assign_subsets(spark, sf):
    return selection.assign_subsets(fx.images(spark, sf), 3).select("category", "image_id", "subset")


def q_select_layers(spark, sf):
    return feat6(selection.select_layers(fx.patches(spark, sf), [1])).select("category", "image_id", "layer", "patch_id", "feat")


def q_grid_coords(spark, sf):
    cls = fx.patches(spark, sf).withColumn("patch_id", F.col("patch_id") + 1).drop("gy", "gx")
    zero = cls.where("patch_id = 1").withColumn("patch_id", F.lit(0))
    return selection.grid_coords(cls.unionByName(zero), has_cls=True).select("image_id", "backbone", "layer", "patch_id", "gy", "gx")


def q_drop_normal_types(spark, sf):
    return selection.drop_normal_types(fx.images(spark, sf)).select("category", "image_id", "anomaly_type", "is_anomaly")


def q_binary_mask(spark, sf):
    return maps.binary_mask(fx.pixels(spark, sf), ["image_id"]).select("image_id", "y", "x", "binary")


def q_percentile_mask(spark, sf):
    return maps.percentile_mask(fx.pixels(spark, sf), ["image_id"]).select("image_id", "y", "x", "binary")


def q_heat_levels(spark, sf):
    one = maps.heat_levels(fx.pixels(spark, sf), ["image_id"])
    every = maps.heat_levels(fx.pixels(spark, sf), ["image_id"], "whole_norm").withColumnRenamed("level", "whole_level")
    return one.join(every.select("image_id", "y", "x", "whole_level"), ["image_id", "y", "x"]).select("image_id", "y", "x", "level", "whole_level")


def q_channel_standardize(spark, sf):
    return feat6(fx.patches(spark, sf, layers=(0,)).withColumn("feat", V.channel_standardized(F.col("feat"), MEAN, STD))).select("image_id", "patch_id", "feat")


def q_l2_normalize(spark, sf):
    return feat6(unit_patches(spark, sf)).select("image_id", "patch_id", "feat")


def q_layer_norm_image(spark, sf):
    return feat6(local.layer_norm_image(fx.patches(spark, sf), ["image_id", "layer"])).select("image_id", "layer", "patch_id", "feat")


def q_unfold_patches(spark, sf):
    return feat6(local.unfold_patches(fx.patches(spark, sf, layers=(0,)), 3, ["image_id"], 4))


def q_adaptive_avg_pool(spark, sf):
    return feat6(fx.image_vectors(spark, sf).withColumn("vec", V.adaptive_avg_pooled(F.col("vec"), 7)).select("image_id", "vec"), "vec")


def q_local_aggregate(spark, sf):
    return feat6(local.local_aggregate(fx.patches(spark, sf), 3, ["image_id", "layer"])).select("image_id", "layer", "gy", "gx", "feat")


def q_local_aggregate_multi(spark, sf):
    return feat6(local.local_aggregate_multi(fx.patches(spark, sf), [1, 3, 5], ["image_id", "layer"])).select("image_id", "layer", "degree", "gy", "gx", "feat")


def q_resample_grid(spark, sf):
    return feat6(local.resample_grid(fx.patches(spark, sf, layers=(0,)), 4, 6, ["image_id"]))


def q_upsample_map(spark, sf):
    return r6(local.upsample_map(grid_scores(spark, sf), 4, SIZE, ["category", "image_id"]), "score")


def q_patch_to_image_min(spark, sf):
    return r6(neighbors.patch_to_image_min(unit_patches(spark, sf), KEYS), "d")


def q_patch_to_reference_min(spark, sf):
    return r6(neighbors.patch_to_reference_min(unit_patches(spark, sf), ref_patches(spark, sf, 1), KEYS), "d")


def q_fuser_training_pairs(spark, sf):
    return r6(training_pairs(spark, sf), "x1", "x2")


def q_join_backbones(spark, sf):
    return r6(backbone_means(spark, sf), "m1", "m2", "x1", "x2")


def q_semi_join_reference(spark, sf):
    return feat6(ref_patches(spark, sf, 1)).select("category", "image_id", "patch_id", "feat")


def q_image_similarity(spark, sf):
    return r6(graph.image_similarity(fx.image_vectors(spark, sf), ["category"]), "w")


def q_rescore_external(spark, sf):
    scores = fx.image_scores(spark, sf).withColumn("dataset", F.lit("mvtec_ad"))
    store = fx.image_vectors(spark, sf).withColumn("dataset", F.lit("mvtec_ad"))
    return r6(graph.rescore_external(scores, store, "mvtec_ad", digits=DIGITS), "score")


def q_interval_mean(spark, sf):
    intervals = {"s0": (0, 0.3), "s1": (0.02, 0.3), "s2": (2, 5), "s3": (0.5, 0.1)}
    return r6(scoring.mutual_intervals(unit_patches(spark, sf), KEYS, intervals), *intervals).select("image_id", "patch_id", *intervals)


def q_mutual_score(spark, sf):
    return r6(mutual(spark, sf, (0, 1)), "score")


def q_fused_reference_score(spark, sf):
    w = oneclass.fit_one_class(training_pairs(spark, sf), KEYS)
    out = scoring.fused_reference_score(unit_patches(spark, sf, 1), unit_patches(spark, sf, 2), ref_patches(spark, sf, 1), ref_patches(spark, sf, 2), w, KEYS, KEYS)
    return r6(out, "score")


def q_mean_over_layers(spark, sf):
    return r6(scoring.mean_over_layers(mutual(spark, sf, (0, 1)), ["category", "image_id", "patch_id"]), "score")


def q_mean_over_degrees(spark, sf):
    z = local.local_aggregate_multi(fx.patches(spark, sf, layers=(0,)), R_LIST, [*IMAGE])
    s = scoring.mutual_score(z, [*KEYS, "degree"])
    return r6(scoring.mean_over_degrees(s, ["category", "image_id", "patch_id"]), "score")


def q_image_score(spark, sf):
    return r6(scoring.image_score(local.upsample_map(grid_scores(spark, sf), 4, SIZE, ["category", "image_id"]), ["category", "image_id"]), "score")


def q_minmax_scores(spark, sf):
    return r6(graph.minmax_scores(fx.image_scores(spark, sf), ["category"]), "score").select("category", "image_id", "score")


def q_graph_smooth(spark, sf):
    return r6(graph.graph_smooth(graph_edges(spark, sf), fx.image_scores(spark, sf), 2, ["category"]), "score")


def q_rescore_graph(spark, sf):
    return r6(graph.rescore_graph(fx.image_vectors(spark, sf), fx.image_scores(spark, sf), [1, 2, 3], ["category"], DIGITS), "score")


def q_top_k_neighbors(spark, sf):
    return r6(graph_edges(spark, sf), "w")


def q_confusion_curve(spark, sf):
    return r6(metrics.confusion_curve(fx.events(spark, sf), ["grp"]), "precision", "recall", "fpr")


def q_cumulative_counts(spark, sf):
    return metrics.cumulative_counts(fx.lineitem(spark, sf), ["grp"])


def _both(spark, sf, f, column):
    return r6(f(fx.events(spark, sf), ["grp"]).unionByName(f(fx.lineitem(spark, sf), ["grp"])), column)


def q_auroc(spark, sf):
    return _both(spark, sf, metrics.auroc, "auroc")


def q_average_precision(spark, sf):
    return _both(spark, sf, metrics.average_precision, "ap")


def q_f1_max(spark, sf):
    return _both(spark, sf, metrics.f1_max, "f1")


def q_image_metrics(spark, sf):
    return r6(metrics.image_metrics(fx.image_scores(spark, sf), ["category"]), "auroc_sp", "f1_sp", "ap_sp")


def q_label_regions(spark, sf):
    return metrics.label_regions(fx.pixels(spark, sf), ["category", "image_id"])


def overlap_curve(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.region_overlap_curve(fx.pixels(spark, sf), ["category"], ["image_id"])


def q_region_overlap_curve(spark, sf):
    return r6(overlap_curve(spark, sf), "threshold", "overlap", "fpr")


def q_aupro(spark, sf):
    return r6(metrics.aupro(overlap_curve(spark, sf), ["category"]), "aupro")


def q_pixel_metrics(spark, sf):
    return r6(metrics.pixel_metrics(fx.pixels(spark, sf), ["category"], ["image_id"]), "auroc_px", "f1_px", "ap_px", "aupro")


def q_evaluate(spark, sf):
    return r6(pipelines.evaluate_packed(fx.image_scores(spark, sf), scratch.stored(fx.maps(spark, sf), "maps")), *sinks.REPORT_COLUMNS[1:])


def q_category_report(spark, sf):
    """The report alone, on ranking metrics of events against two labels; their share of positives stands in for the region metric."""
    events = fx.events(spark, sf)
    px = metrics.ranking_metrics(events, ["grp"]).select(F.col("grp").alias("category"), F.col("auroc").alias("auroc_px"), F.col("f1").alias("f1_px"), F.col("ap").alias("ap_px"), (F.col("n1") / (F.col("n1") + F.col("n0"))).alias("aupro"))
    sp = metrics.ranking_metrics(events, ["grp"], "score", "label3").select(F.col("grp").alias("category"), F.col("auroc").alias("auroc_sp"), F.col("f1").alias("f1_sp"), F.col("ap").alias("ap_sp"))
    return r6(metrics.category_report(px.join(sp, "category")), *sinks.REPORT_COLUMNS[1:])


def q_select_pseudo_normal(spark, sf):
    return r6(selection.select_pseudo_normal(fx.image_scores(spark, sf), ["category"]), "score").select("category", "image_id", "score")


def q_union_subsets(spark, sf):
    parts = selection.assign_subsets(fx.images(spark, sf), 2)
    whole = selection.union_subsets([parts.where(F.col("subset") == i) for i in range(2)])
    return whole.groupBy("category", "subset").agg(F.count("*").alias("images"), F.sum("is_anomaly").alias("anomalous"))


def q_fit_one_class(spark, sf):
    return r6(oneclass.fit_one_class(training_pairs(spark, sf), KEYS), "w1", "w2", "offset")


def q_apply_one_class(spark, sf):
    w = oneclass.fit_one_class(training_pairs(spark, sf), KEYS)
    return r6(scoring.apply_one_class(backbone_means(spark, sf), w, KEYS), "svm").select(*IMAGE, "patch_id", "svm")


def q_pipeline_mutual(spark, sf):
    return r6(pipelines.pipeline_mutual(fx.patches(spark, sf), fx.image_vectors(spark, sf), SIZE, digits=DIGITS), "score")


def q_pipeline_fused(spark, sf):
    _, scores = pipelines.pipeline_fused(fx.patches(spark, sf, 1), fx.patches(spark, sf, 2), fx.image_vectors(spark, sf), SIZE, R_LIST, digits=DIGITS)
    return r6(scores, "score")


def queries() -> dict:
    return {n[2:]: f for n, f in globals().items() if n.startswith("q_")}
