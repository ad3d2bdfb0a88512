"""Local neighbourhoods on patch grids: layer norm, unfolding, aggregation, resampling.

Patch tables have ``keys..., image_id, patch_id, gy, gx, feat``. The relational forms here are
built-in expressions; ``local_aggregate`` packs an image's grid into one row and does the
box mean in NumPy, as exploding r * r neighbours per patch would not scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

EPS = 1e-5


def layer_norm_image(patches: DataFrame, keys: list[str]) -> DataFrame:
    """(x - mean) / sqrt(var + 1e-5), both over all patches and channels of an image; ``keys`` name the image (with its layer).

    Two passes, so that the variance doesn't lose digits.
    """
    n = F.sum(F.size("feat"))
    means = patches.groupBy(*keys).agg((F.sum(V.total(F.col("feat"))) / n).alias("__mean"))
    moved = patches.join(means, keys).withColumn("feat", F.expr("transform(feat, x -> x - __mean)")).drop("__mean")
    spread = moved.groupBy(*keys).agg((F.sum(V.dot(F.col("feat"), F.col("feat"))) / n).alias("__var"))
    return moved.join(spread, keys).withColumn("feat", F.expr(f"transform(feat, x -> x / sqrt(__var + {EPS}D))")).drop("__var")


def unfold_patches(patches: DataFrame, r: int, keys: list[str], side: int, stride: int = 1) -> DataFrame:
    """Each output cell ``oy, ox`` with its r x r window ``dy, dx, feat`` (zero-padded cells are left out: they add nothing).

    Padding is int((r - 1) / 2) on every side; the output side is
    int((side + 2 pad - (r - 1) - 1) / stride + 1), so an even r loses a row and a column.
    """
    pad = (r - 1) // 2
    out = (side + 2 * pad - r) // stride + 1
    offsets = F.explode(F.sequence(F.lit(0), F.lit(r - 1)))
    at = patches.select(*keys, "gy", "gx", "feat", offsets.alias("dy")).select("*", offsets.alias("dx"))
    oy, ox = F.col("gy") + pad - F.col("dy"), F.col("gx") + pad - F.col("dx")
    fits = (oy >= 0) & (ox >= 0) & (oy % stride == 0) & (ox % stride == 0) & (oy < out * stride) & (ox < out * stride)
    return at.where(fits).select(*keys, F.floor(oy / stride).cast("int").alias("oy"), F.floor(ox / stride).cast("int").alias("ox"), "dy", "dx", "feat")


def pack_images(patches: DataFrame | list[DataFrame], keys: list[str]) -> DataFrame:
    """One row per image and layer: ``patch_ids``, ``flat``, the vectors end to end in patch order, and ``n``, how many numbers that is. One image's grid is a bounded group.

    Of two backbones' tables the vectors are ``flat1`` and ``flat2``, of the images that both have; still one shuffle.
    """
    if isinstance(patches, DataFrame):
        rows = F.sort_array(F.collect_list(F.struct("patch_id", "feat")))
        return patches.groupBy(*keys).agg(rows.alias("__p")).select(*keys, F.col("__p.patch_id").alias("patch_ids"), F.flatten(F.col("__p.feat")).alias("flat")).withColumn("n", F.size("flat").cast("long"))
    both = [p.select(*keys, F.lit(i).alias("__b"), F.col("patch_id").cast("int").alias("patch_id"), F.col("feat").cast("array<double>").alias("feat")) for i, p in enumerate(patches)]
    packed = both[0].unionByName(both[1]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__b", "patch_id", "feat"))).alias("__p"))
    own = [F.expr(f"filter(__p, x -> x.__b = {i})") for i in range(2)]
    flat = packed.select(*keys, F.transform(own[0], lambda x: x["patch_id"]).alias("patch_ids"), *(F.flatten(F.transform(o, lambda x: x["feat"])).alias(f"flat{i + 1}") for i, o in enumerate(own)))
    return flat.where("size(flat1) > 0 and size(flat2) > 0").withColumn("n", (F.size("flat1") + F.size("flat2")).cast("long"))


def unpack_images(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Back to a row per patch, with ``gy, gx``."""
    n = F.size("patch_ids")
    c = (F.size("flat") / n).cast("int")
    side = F.floor(F.sqrt(n)).cast("int")
    at = packed.select(*keys, "flat", c.alias("__c"), side.alias("__s"), F.posexplode("patch_ids").alias("__i", "patch_id"))
    return at.select(*keys, "patch_id", F.floor(F.col("patch_id") / F.col("__s")).cast("int").alias("gy"), (F.col("patch_id") % F.col("__s")).alias("gx"), F.slice("flat", F.col("__i") * F.col("__c") + 1, F.col("__c")).alias("feat"))


def _pool(x: np.ndarray, m: int) -> np.ndarray:
    """Adaptive average pooling of the last axis to m bins."""
    n = x.shape[-1]
    sums = np.concatenate([np.zeros((*x.shape[:-1], 1)), np.cumsum(x, -1)], -1)
    low = np.arange(m) * n // m
    high = -(-(np.arange(1, m + 1) * n) // m)
    return (sums[..., high] - sums[..., low]) / (high - low)


def half_pixel_sources(side: int, size: int) -> list[tuple[int, float]]:
    """Where the centres of ``size`` output cells fall between the centres of ``side`` cells."""
    src = [max(0.0, (i + 0.5) * side / size - 0.5) for i in range(size)]
    return [(int(s), s - int(s)) for s in src]


def _weights(side: int, sources: list[tuple[int, float]]) -> np.ndarray:
    """The matrix [output cells, cells] of a linear resampling."""
    a = np.zeros((len(sources), side))
    for y, (low, f) in enumerate(sources):
        a[y, low] += 1 - f
        a[y, min(low + 1, side - 1)] += f
    return a


def aggregate_grid(x: np.ndarray, r: int, out_dim: int, normalize: bool, side_out: int | None = None) -> np.ndarray:
    """Layer norm, r x r neighbourhoods, pooling to ``out_dim`` and (optionally) unit length, of one image [patches, channels].

    With ``side_out`` a grid of another side is resampled to what that side would give, before the
    lengths are made one (bilinear, half-pixel centres; pooling and resampling don't mind their order).
    """
    n, c = x.shape
    side = int(np.sqrt(n))
    z = ((x - x.mean()) / np.sqrt(x.var() + EPS)).reshape(side, side, c)
    if r == 1:
        out = z.reshape(-1, c) if out_dim == c else _pool(z.reshape(-1, c), out_dim)
    else:
        pad = (r - 1) // 2
        size = side + 2 * pad - r + 1
        padded = np.pad(z, ((pad, pad), (pad, pad), (0, 0)))
        if out_dim == c:  # bin c is channel c's window: a box mean, in two passes
            rows = sum(padded[i : i + size] for i in range(r))
            out = sum(rows[:, i : i + size] for i in range(r)).reshape(-1, c) / (r * r)
        else:  # the window laid out channel by channel
            windows = np.lib.stride_tricks.sliding_window_view(padded, (r, r), (0, 1)).reshape(size * size, c * r * r)
            out = _pool(windows, out_dim)
    if side_out is not None and side_out != side:
        have = int(np.sqrt(len(out)))
        a = _weights(have, half_pixel_sources(have, have + side_out - side))
        out = np.einsum("yg,gkc,xk->yxc", a, out.reshape(have, have, -1), a, optimize=True).reshape(-1, out.shape[1])
    return out / np.linalg.norm(out, axis=1, keepdims=True) if normalize else out


def aggregate_packed(packed: DataFrame, r_list: list[int], keys: list[str], out_dim: int | None = None, normalize: bool = True, side: int | None = None) -> DataFrame:
    """Packed rows at every degree of ``r_list``: ``keys..., degree, patch_ids, flat..., n``. No shuffle.

    ``keys`` name an image and layer. ``side`` is the grid of the first layer, to which layers of
    another grid are resampled. Each backbone keeps its width unless ``out_dim`` is given. A zero vector normalises to NaN.
    """
    flats = [c for c in packed.columns if c.startswith("flat") and c not in keys]
    schema = ", ".join([*(f"`{k}` {packed.schema[k].dataType.simpleString()}" for k in keys), "degree int", "patch_ids array<int>", *(f"{c} array<double>" for c in flats), "n long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n = len(row.column("patch_ids")[0])
                grids = [np.asarray(row.column(c).flatten()).reshape(n, -1) for c in flats]
                for r in r_list:
                    with np.errstate(invalid="ignore", divide="ignore"):
                        z = [aggregate_grid(x, r, out_dim or x.shape[1], normalize, side) for x in grids]
                    lists = [pa.array([np.arange(len(z[0]), dtype=np.int32)], pa.list_(pa.int32())), *(pa.array([x.ravel()], pa.list_(pa.float64())) for x in z)]
                    yield pa.RecordBatch.from_arrays([*(row.column(k) for k in keys), pa.array([r], pa.int32()), *lists, pa.array([sum(x.size for x in z)], pa.int64())], names=[*keys, "degree", "patch_ids", *flats, "n"])

    return packed.select(*keys, "patch_ids", *flats).mapInArrow(run, schema)


def local_aggregate_multi(patches: DataFrame, r_list: list[int], keys: list[str], out_dim: int | None = None, normalize: bool = True, side: int | None = None) -> DataFrame:
    """Aggregated vectors at every degree of ``r_list`` in one job: ``keys..., degree, patch_id, gy, gx, feat``. One shuffle, to bring an image's patches together."""
    return unpack_images(aggregate_packed(pack_images(patches, keys), r_list, keys, out_dim, normalize, side), [*keys, "degree"])


def local_aggregate(patches: DataFrame, r: int, keys: list[str], out_dim: int | None = None, normalize: bool = True, side: int | None = None) -> DataFrame:
    """``local_aggregate_multi`` at one degree."""
    return local_aggregate_multi(patches, [r], keys, out_dim, normalize, side)


def _taps(spark, sources: list[tuple[int, float]], side: int, name: str, grid: str) -> DataFrame:
    """The (up to two) source cells of each output coordinate and their weights: a table of a grid side's size."""
    rows = []
    for i, (low, f) in enumerate(sources):
        high = min(low + 1, side - 1)
        rows += [(i, low, 1.0 - f), (i, high, f)] if high != low else [(i, low, 1.0)]
    return spark.createDataFrame([x for x in rows if x[2]], f"{name} int, {grid} int, w{name} double")


def _resized(df: DataFrame, keys: list[str], side: int, sources: list[tuple[int, float]], weighted) -> DataFrame:
    spark = df.sparkSession
    ys, xs = _taps(spark, sources, side, "y", "gy"), _taps(spark, sources, side, "x", "gx")
    # two tables of 2 * side rows each
    return weighted(df.join(F.broadcast(ys), "gy").join(F.broadcast(xs), "gx"), [*keys, "y", "x"])


def resample_grid(patches: DataFrame, in_side: int, out_side: int, keys: list[str]) -> DataFrame:
    """Bilinear resampling of vectors onto another grid, half-pixel centres: ``keys..., y, x, feat``.

    One shuffle packs an image's grid; two small matrices resample it there. Missing cells count as zero, and an output cell with no cell of its own under it is left out.
    """
    grid = patches.groupBy(*keys).agg(F.collect_list(F.struct(F.col("gy").cast("int").alias("gy"), F.col("gx").cast("int").alias("gx"), F.col("feat").cast("array<double>").alias("feat"))).alias("__p"))
    packed = grid.select(*keys, F.col("__p.gy").alias("gy"), F.col("__p.gx").alias("gx"), F.flatten(F.col("__p.feat")).alias("flat"))
    schema = ", ".join([*(f"`{k}` {patches.schema[k].dataType.simpleString()}" for k in keys), "y int, x int, feat array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _weights(in_side, half_pixel_sources(in_side, out_side))
        for batch in batches:
            for i in range(batch.num_rows):
                gy, gx, flat = (np.asarray(batch.column(c)[i].values) for c in ("gy", "gx", "flat"))
                cells = np.zeros((in_side, in_side, len(flat) // len(gy)))
                there = np.zeros((in_side, in_side))
                cells[gy, gx], there[gy, gx] = flat.reshape(len(gy), -1), 1.0
                out = np.einsum("yg,gkc,xk->yxc", a, cells, a, optimize=True)
                y, x = np.nonzero(a @ there @ a.T)
                ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * cells.shape[2])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(np.full(len(y), i))) for k in keys), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(out[y, x].ravel()))], names=[*keys, "y", "x", "feat"])

    return packed.mapInArrow(run, schema)


def corner_sources(side: int, size: int) -> list[tuple[int, float]]:
    """Where output coordinates fall on a grid of ``side`` when corners map to corners."""
    src = [i * (side - 1) / (size - 1) if size > 1 else 0.0 for i in range(size)]
    return [(int(s), s - int(s)) for s in src]


def upsample_map(scores: DataFrame, side: int, size: int, keys: list[str]) -> DataFrame:
    """Bilinear map of ``size`` x ``size`` pixels from grid scores ``gy, gx, score``, corners kept: ``keys..., y, x, score``."""

    def weighted(met: DataFrame, by: list[str]) -> DataFrame:
        return met.groupBy(*by).agg(F.sum(F.col("score") * F.col("wy") * F.col("wx")).alias("score"))

    return _resized(scores, keys, side, corner_sources(side, size), weighted)


def upsample_packed(scores: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """The same map as one row per image, ``keys..., map`` (row-major): two small matrix products per image, no row per pixel."""
    grid = F.transform(F.sort_array(F.collect_list(F.struct("patch_id", "score"))), lambda s: s["score"])
    packed = scores.groupBy(*keys).agg(grid.alias("grid"))
    schema = ", ".join([*(f"`{k}` {scores.schema[k].dataType.simpleString()}" for k in keys), "map array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                s = np.asarray(row.column("grid").flatten())
                side = int(np.sqrt(len(s)))
                a = _weights(side, corner_sources(side, size))
                yield pa.RecordBatch.from_arrays([*(row.column(k) for k in keys), pa.array([(a @ s.reshape(side, side) @ a.T).ravel()], pa.list_(pa.float64()))], names=[*keys, "map"])

    return packed.mapInArrow(run, schema)


def upsample_scores(scores: DataFrame, size: int, keys: list[str], parts: list[str]) -> DataFrame:
    """``keys..., map, peak`` from ``keys..., parts..., patch_ids, score``, arrays per image: the mean over the last column of ``parts``, then over the one before, and so on, as a map of ``size`` x ``size`` and its largest pixel.

    An image's few arrays meet in one row (a hash shuffle of scores, no row per patch or pixel).
    """
    packed = scores.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*parts, "score"))).alias("__s"))
    schema = ", ".join([*(f"`{k}` {scores.schema[k].dataType.simpleString()}" for k in keys), "map array<double>", "peak double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                each = {tuple(x[p].as_py() for p in parts): np.asarray(x["score"].values) for x in batch.column("__s")[i].values}
                while len(next(iter(each))):
                    groups: dict[tuple, list] = {}
                    for at, v in each.items():
                        groups.setdefault(at[:-1], []).append(v)
                    each = {at: sum(v[1:], v[0]) / len(v) for at, v in groups.items()}
                s = each[()]
                side = int(np.sqrt(len(s)))
                a = _weights(side, corner_sources(side, size))
                full = (a @ s.reshape(side, side) @ a.T).ravel()
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in keys), pa.array([full], pa.list_(pa.float64())), pa.array([full.max()])], names=[*keys, "map", "peak"])

    return packed.mapInArrow(run, schema)


def map_pixels(maps: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """A row per pixel of packed maps: ``keys..., y, x, score``."""
    at = maps.select(*keys, F.posexplode("map").alias("__p", "score"))
    return at.select(*keys, F.floor(F.col("__p") / size).cast("int").alias("y"), (F.col("__p") % size).alias("x"), "score")
