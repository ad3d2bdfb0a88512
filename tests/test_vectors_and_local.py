import numpy as np
import pytest
from pyspark.sql import functions as F

from herdwise.functions import vectors as V
from herdwise.operators import local

PATCH = "image_id long, layer int, patch_id int, gy int, gx int, feat array<double>"


def grid(spark, x, image=1):
    side = int(np.sqrt(len(x)))
    return spark.createDataFrame([(image, 0, i, i // side, i % side, [float(v) for v in row]) for i, row in enumerate(x)], PATCH)


def values(df, by=("gy", "gx"), column="feat"):
    return np.array([r[column] for r in df.orderBy(*by).collect()])


def one(spark, v, f):
    return spark.createDataFrame([(v,)], "v array<double>").select(f(F.col("v")).alias("o")).first()["o"]


def test_normalised_vectors_have_length_one_and_zero_gives_null(spark):
    assert one(spark, [3.0, 4.0], V.l2_normalized) == pytest.approx([0.6, 0.8])
    assert one(spark, [0.0, 0.0], V.l2_normalized) == [None, None]


@pytest.mark.parametrize(("n", "m", "bins"), [(5, 3, [(0, 2), (1, 4), (3, 5)]), (4, 4, [(0, 1), (1, 2), (2, 3), (3, 4)]), (9, 1, [(0, 9)])])
def test_pooling_bins(spark, n, m, bins):
    v = [float(x * x) for x in range(n)]
    assert one(spark, v, lambda c: V.adaptive_avg_pooled(c, m)) == pytest.approx([np.mean(v[a:b]) for a, b in bins])
    assert local._pool(np.array([v]), m)[0] == pytest.approx([np.mean(v[a:b]) for a, b in bins])


def test_channels_are_standardised(spark):
    assert one(spark, [1.0, 4.0], lambda c: V.channel_standardized(c, [1.0, 2.0], [2.0, 4.0])) == pytest.approx([0.0, 0.5])


def test_box_mean_counts_missing_cells_as_zero():
    x = np.ones((9, 1))
    norm = local.EPS
    z = local.aggregate_grid(x * 0 + np.arange(9)[:, None], 1, 1, False)
    assert z.mean() == pytest.approx(0) and z.var() == pytest.approx(1, abs=1e-4) and norm < 1
    # without layer norm: windows of ones
    padded = np.pad(np.ones((3, 3)), 1)
    box = sum(padded[i : i + 3, j : j + 3] for i in range(3) for j in range(3)) / 9
    assert box == pytest.approx(np.array([[4, 6, 4], [6, 9, 6], [4, 6, 4]]) / 9)


def test_unfolding_and_box_mean_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(16, 3))
    z = (x - x.mean()) / np.sqrt(x.var() + local.EPS)
    windows = local.unfold_patches(grid(spark, z), 3, ["image_id"], 4).select("oy", "ox", F.posexplode("feat").alias("c", "v"))
    sums = windows.groupBy("oy", "ox", "c").agg((F.sum("v") / 9).alias("v"))
    box = np.array([r["v"] for r in sums.orderBy("oy", "ox", "c").collect()]).reshape(16, 3)
    got = values(local.local_aggregate(grid(spark, x), 3, ["image_id", "layer"], normalize=False))
    assert got == pytest.approx(box)


def test_layer_norm_matches_the_packed_form(spark):
    x = np.random.default_rng(1).normal(size=(9, 2)) * 5 + 3
    got = values(local.layer_norm_image(grid(spark, x), ["image_id", "layer"]))
    assert got == pytest.approx(local.aggregate_grid(x, 1, 2, False))


def test_degree_one_is_the_normalised_input_and_even_degrees_shrink(spark):
    x = np.random.default_rng(2).normal(size=(16, 4))
    z = local.aggregate_grid(x, 1, 4, True)
    assert np.linalg.norm(z, axis=1) == pytest.approx(np.ones(16))
    assert local.aggregate_grid(x, 2, 4, False).shape == (9, 4)
    both = local.local_aggregate_multi(grid(spark, x), [1, 3], ["image_id", "layer"])
    assert both.where("degree = 1").count() == 16 and both.where("degree = 3").count() == 16


def test_general_output_width_pools_channel_major():
    x = np.random.default_rng(3).normal(size=(9, 2))
    z = ((x - x.mean()) / np.sqrt(x.var() + local.EPS)).reshape(3, 3, 2)
    padded = np.pad(z, ((1, 1), (1, 1), (0, 0)))
    flat = np.concatenate([padded[0:3, 0:3, c].ravel() for c in range(2)])
    assert local.aggregate_grid(x, 3, 3, False)[0] == pytest.approx([flat[0:6].mean(), flat[6:12].mean(), flat[12:18].mean()])


def test_upsampling_keeps_corners(spark):
    s = spark.createDataFrame([(1, 0, 0, 0, 1.0), (1, 1, 0, 1, 2.0), (1, 2, 1, 0, 3.0), (1, 3, 1, 1, 6.0)], "image_id long, patch_id int, gy int, gx int, score double")
    want = np.array([[1, 1.5, 2], [2, 3, 4], [3, 4.5, 6]])
    assert values(local.upsample_map(s, 2, 3, ["image_id"]), ("y", "x"), "score").reshape(3, 3) == pytest.approx(want)
    packed = local.map_pixels(local.upsample_packed(s, 3, ["image_id"]), 3, ["image_id"])
    assert values(packed, ("y", "x"), "score").reshape(3, 3) == pytest.approx(want)
    assert values(local.upsample_map(s, 2, 1, ["image_id"]), ("y", "x"), "score") == pytest.approx([1.0])


def test_resampling_uses_half_pixel_centres(spark):
    got = values(local.resample_grid(grid(spark, [[0.0], [1.0], [2.0], [3.0]]), 2, 4, ["image_id"]), ("y", "x"))[:, 0].reshape(4, 4)
    line = np.array([0.0, 0.25, 0.75, 1.0])
    assert got == pytest.approx(2 * line[:, None] + line[None, :])


@pytest.mark.parametrize("r", [1, 3])
def test_layers_of_another_grid_are_resampled_before_their_lengths_are_one(spark, r):
    x = np.random.default_rng(5).normal(size=(4, 3))
    box = local.aggregate_grid(x, r, 3, False)
    want = values(local.resample_grid(grid(spark, box), 2, 4, ["image_id"]), ("y", "x"))
    got = values(local.local_aggregate(grid(spark, x), r, ["image_id", "layer"], side=4))
    assert got == pytest.approx(want / np.linalg.norm(want, axis=1, keepdims=True))
    assert values(local.local_aggregate(grid(spark, x), r, ["image_id", "layer"], side=2)) == pytest.approx(local.aggregate_grid(x, r, 3, True))
