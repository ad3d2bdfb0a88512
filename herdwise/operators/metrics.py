"""Ranking metrics of scores and labels, by key, and region metrics of pixel maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .components import components
from .ranking import in_ranges, running_sums


def _curve(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """``keys..., score, p, n, tp, fp, n1, n0``: the counts at each distinct score, down to it, and in all."""
    hit = F.when(F.col(label) == 1, 1).otherwise(0)
    counts = df.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(hit).alias("p"), F.sum(1 - hit).alias("n"))
    down = [F.col("score").desc()]
    return running_sums(in_ranges(counts, keys, down, "score-counts"), keys, down, {"p": ("tp", "n1"), "n": ("fp", "n0")})


def cumulative_counts(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """``keys..., score, p, n, tp, fp``: labels 1 and 0 at each distinct score, and at that score or above.

    Equal scores are counted first (combined before the shuffle, so a hot score is one row);
    distinct ones are dealt into ranges, whose totals give each range its offset. No task sorts a whole key.
    """
    return _curve(df, keys, score, label).select(*keys, "score", "p", "n", "tp", "fp")


def confusion_curve(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """``keys..., score, tp, fp, precision, recall, fpr`` at every distinct score; recall or fpr is NULL without positives or negatives."""
    met = _curve(df, keys, score, label)
    return met.select(*keys, "score", "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "n1").alias("recall"), F.try_divide("fp", "n0").alias("fpr"))


def _area() -> Column:
    # a step of n negatives from tp - p to tp true positives; all of it whole numbers
    return F.try_divide(F.sum(F.col("n") * (2 * F.col("tp") - F.col("p"))).cast("double") / 2.0, F.sum("p").cast("double") * F.sum("n").cast("double"))


def _precision_sum() -> Column:
    return F.try_divide(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("p"))


def ranking_metrics(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """``keys..., n1, n0, auroc, ap, f1`` from one curve. ``auroc`` is NULL without both labels, ``ap`` and ``f1`` without positives."""
    # 2PR / (P + R) = 2 TP / (TP + FP + n1), finite where TP > 0
    f1 = F.max(F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n1"))))
    return _curve(df, keys, score, label).groupBy(*keys).agg(F.max("n1").alias("n1"), F.max("n0").alias("n0"), _area().alias("auroc"), _precision_sum().alias("ap"), f1.alias("f1"))


def auroc(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """ROC area; ties count one half."""
    return ranking_metrics(df, keys, score, label).select(*keys, "auroc")


def average_precision(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Sum of recall steps times precision."""
    return ranking_metrics(df, keys, score, label).select(*keys, "ap")


def f1_max(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """The best F1 over all thresholds."""
    return ranking_metrics(df, keys, score, label).select(*keys, "f1")


def image_metrics(scores: DataFrame, keys: list[str], score: str = "score", label: str = "is_anomaly") -> DataFrame:
    """``auroc_sp, f1_sp, ap_sp`` per key; all 0 where labels are missing, all 0 or all 1."""
    m = ranking_metrics(scores.where(F.col(label).isNotNull()), keys, score, label)
    both = (F.col("n1") > 0) & (F.col("n0") > 0)
    found = m.select(*keys, *(F.when(both, F.col(a)).otherwise(0.0).alias(b) for a, b in (("auroc", "auroc_sp"), ("f1", "f1_sp"), ("ap", "ap_sp"))))
    return scores.select(*keys).distinct().join(found, keys, "left").na.fill(0.0, ["auroc_sp", "f1_sp", "ap_sp"])


def _joined_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n vertices the smallest vertex that edges (a, b) connect it with: roots hang onto smaller roots, and paths are cut short in between."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
    return label


def _regions(mask: np.ndarray) -> np.ndarray:
    """Each set pixel's region, named by the least row-major position in it; 8 neighbours, 0-based, -1 elsewhere.

    A line's set pixels are cut into runs, runs of neighbouring lines that touch are edges of a small graph, and its components are the regions.
    """
    h, w = mask.shape
    # a blank column between lines, so that runs end there
    flat = np.zeros((h, w + 2), np.int8)
    flat[:, 1:-1] = mask
    change = np.diff(flat.ravel(), prepend=np.int8(0))
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)  # ends are exclusive
    # the runs of the next line that touch, corners included
    first, last = np.searchsorted(end, start + w + 2, "left"), np.searchsorted(start, end + w + 2, "right")
    n = np.maximum(0, last - first)
    a = np.repeat(np.arange(len(start)), n)
    b = np.repeat(first, n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
    label = _joined_labels(len(start), a, b)
    name = (start[label] // (w + 2)) * w + start[label] % (w + 2) - 1
    out = np.full((h, w), -1)
    out[np.asarray(mask, bool)] = np.repeat(name, end - start)
    return out


def _packed(pixels: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per image (``keys`` name it), its pixels as arrays; an image is a bounded group."""
    rows = F.collect_list(F.struct("y", "x", *columns))
    return pixels.groupBy(*keys).agg(rows.alias("__p")).select(*keys, *(F.col(f"__p.{c}").alias(c) for c in ("y", "x", *columns)))


def _arrays(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(row, its arrays) of packed images."""
    lists = [batch.column(c) for c in columns]
    flat, ends = [np.asarray(x.flatten()) for x in lists], np.asarray(lists[0].offsets) - lists[0].offsets[0].as_py()
    for i in range(batch.num_rows):
        yield i, [f[ends[i] : ends[i + 1]] for f in flat]


def _labelled(y: np.ndarray, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The region of each pixel of an image, -1 where the mask is not 1."""
    grid = np.zeros((int(y.max()) + 1, int(x.max()) + 1), bool)
    grid[y[mask == 1], x[mask == 1]] = True
    return _regions(grid)[y, x]


#: Side of a tile of an image that is labelled in one place.
TILE = 1024


def label_regions(pixels: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """``keys..., y, x, region`` of every masked pixel: 8-connected regions within an image (``keys`` name it, and must not be null), named by their least row-major position.

    An image is labelled by tiles. Where regions of two tiles touch, an edge joins their names, and rounds
    over those edges alone find what belongs together, so that one very large image is many tasks.
    """
    schema = ", ".join([*(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in keys), "y int, x int, region long"])
    typed = pixels.select(*keys, F.col("y").cast("int"), F.col("x").cast("int"), F.col("mask").cast("int"))
    widths = stored(typed.groupBy(*keys).agg((F.max("x") + 1).alias("width"), F.greatest(F.max("x"), F.max("y")).alias("far")), "image-widths")
    tiled = typed.where("mask = 1").join(widths, keys).withColumn("__ty", F.floor(F.col("y") / tile)).withColumn("__tx", F.floor(F.col("x") / tile))
    packed = _packed(tiled.select(*keys, "width", "__ty", "__tx", "y", "x", "mask"), [*keys, "width", "__ty", "__tx"], ["mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths_ = batch.column("width").to_pylist()
            for i, (y, x, mask) in _arrays(batch, ["y", "x", "mask"]):
                top, left = int(y.min()), int(x.min())
                region = _labelled(y - top, x - left, mask)
                wide = int(x.max()) - left + 1
                name = (region // wide + top).astype(np.int64) * widths_[i] + region % wide + left
                ids = pa.array(np.full(len(y), i))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(ids) for k in keys), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(name)], names=[*keys, "y", "x", "region"])

    out = packed.mapInArrow(run, schema)
    whole = lambda df: df.withColumn("region", F.col("region").cast("int"))
    if (widths.agg(F.max("far")).first()[0] or 0) < tile:
        return whole(out)
    out = stored(out, "tile-regions")
    edge = out.where(f"y % {tile} in (0, {tile - 1}) or x % {tile} in (0, {tile - 1})")
    steps = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)))
    near = edge.select(*keys, F.col("region").alias("a"), "y", "x", steps.alias("s")).select(*keys, "a", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    edges = near.join(edge.withColumnRenamed("region", "b"), [*keys, "y", "x"]).select(*keys, "a", "b")
    roots = components(edges, keys).select(*keys, F.col("u").alias("region"), "v")
    return whole(out.join(roots, [*keys, "region"], "left").select(*keys, "y", "x", F.coalesce("v", "region").alias("region")))


def pack_pixels(pixels: DataFrame, keys: list[str], image: list[str]) -> DataFrame:
    """One row per image with its pixels as arrays ``y, x, mask, map``: one shuffle."""
    typed = pixels.select(*keys, *image, F.col("y").cast("int"), F.col("x").cast("int"), F.col("mask").cast("int"), F.col("score").cast("double").alias("map"))
    return _packed(typed, [*keys, *image], ["mask", "map"])


def _bucket_sums(maps: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., bucket, share, clean_here, regions``, a few rows per image: its regions' shares and its clean pixels by the number of thresholds that lie below them."""
    placed = ["y", "x"] if "y" in maps.columns else []
    met = maps.select(*keys, *placed, "mask", "map").join(ends.select(*keys, "lo", "delta", "steps"), keys)
    schema = ", ".join([*(f"`{k}` {maps.schema[k].dataType.simpleString()}" for k in keys), "bucket int, share double, clean_here long, regions long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (*at, mask, score) in _arrays(batch, [*placed, "mask", "map"]):
                thresholds = batch.column("lo")[i].as_py() + np.arange(batch.column("steps")[i].as_py()) * batch.column("delta")[i].as_py()
                bucket = np.searchsorted(thresholds, score)  # thresholds strictly below
                side = int(np.sqrt(len(mask)))
                names = _labelled(*at, mask) if at else _regions(mask.reshape(side, side) == 1).ravel()
                _, region, area = np.unique(names, return_inverse=True, return_counts=True)
                marked = mask == 1
                share = np.bincount(bucket[marked], 1.0 / area[region[marked]], len(thresholds) + 1).astype(float)
                clean = np.bincount(bucket, 1 - mask, len(thresholds) + 1).astype(np.int64)
                n = len(np.unique(region[marked]))
                some = np.flatnonzero((share > 0) | (clean != 0))
                if not len(some):
                    continue
                counts = np.zeros(len(some), np.int64)
                counts[0] = n
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(np.full(len(some), i))) for k in keys), pa.array(some, pa.int32()), pa.array(share[some]), pa.array(clean[some]), pa.array(counts)], names=[*keys, "bucket", "share", "clean_here", "regions"])

    return met.mapInArrow(run, schema)


def region_overlap_curve(pixels: DataFrame, keys: list[str], image: list[str], max_step: int = 200) -> DataFrame:
    """``keys..., step, threshold, overlap, fpr``: at each threshold from a key's lowest score up, the mean share of regions above it and of clean pixels above it.

    ``image`` are the columns that name an image within a key. One shuffle brings an image's pixels together.
    """
    return overlap_curve_packed(stored(pack_pixels(pixels, keys, image), "packed-pixels"), keys, max_step)


def overlap_curve_packed(maps: DataFrame, keys: list[str], max_step: int = 200) -> DataFrame:
    """``region_overlap_curve`` of packed maps: ``keys...``, ``map`` and ``mask`` as arrays of an image (square and row-major, or placed by ``y, x``).

    An image's regions are labelled where it lies, each pixel is put once into the bucket of
    thresholds it exceeds, and only sums per bucket leave. Sums over buckets from the top give every threshold.
    """
    clean = F.aggregate("mask", F.lit(0).cast("long"), lambda s, m: s + 1 - m)
    ends = maps.groupBy(*keys).agg(F.min(F.array_min("map")).alias("lo"), F.max(F.array_max("map")).alias("hi"), F.sum(clean).alias("clean"))
    ends = ends.where("hi > lo").withColumn("delta", (F.col("hi") - F.col("lo")) / max_step).withColumn("steps", F.ceil((F.col("hi") - F.col("lo")) / F.col("delta")).cast("int"))
    ends = stored(ends, "score-ends")
    # written once: the buckets and the number of regions both come from it
    sums = stored(_bucket_sums(maps, ends, keys).groupBy(*keys, "bucket").agg(F.sum("share").alias("share"), F.sum("clean_here").alias("clean_here"), F.sum("regions").alias("regions")), "bucket-sums")
    n_regions = sums.groupBy(*keys).agg(F.sum("regions").alias("regions"))
    grid = ends.join(n_regions, keys, "left").select(*keys, "lo", "delta", "clean", F.nullif("regions", F.lit(0)).alias("regions"), F.explode(F.sequence(F.lit(0), F.col("steps"))).alias("bucket"))
    # buckets over i count for threshold i; at most max_step + 2 rows per key
    above = Window.partitionBy(*keys).orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(sums.drop("regions"), [*keys, "bucket"], "left").na.fill(0, ["share", "clean_here"])
    out = filled.select(*keys, (F.col("bucket") - 1).alias("step"), "lo", "delta", F.try_divide(F.sum("share").over(above), "regions").alias("overlap"), F.try_divide(F.sum("clean_here").over(above), "clean").alias("fpr"))
    return out.where("step >= 0").select(*keys, "step", (F.col("lo") + F.col("step") * F.col("delta")).alias("threshold"), "overlap", "fpr")


def aupro(curve: DataFrame, keys: list[str], expect_fpr: float = 0.3) -> DataFrame:
    """``keys..., aupro``: trapezoid area under overlap over the false positive rate below ``expect_fpr``, scaled to 0..1. NULL where the rates are all equal."""
    kept = curve.where(F.col("fpr") < F.lit(float(expect_fpr)))
    every, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.col("step").desc())
    lo, hi = F.min("fpr").over(every), F.max("fpr").over(every)
    scaled = kept.withColumn("x", F.try_divide(F.col("fpr") - lo, hi - lo))
    pieces = scaled.withColumn("piece", (F.col("x") - F.lag("x").over(order)) * (F.col("overlap") + F.lag("overlap").over(order)) / 2.0)
    return pieces.groupBy(*keys).agg(F.sum("piece").alias("aupro"))


#: Pixels of a range of scores, and scores of an image that are looked at to place the ranges' bounds.
RANGE_PIXELS, LOOKED_AT = 1 << 20, 64


def ranking_packed(maps: DataFrame, keys: list[str], range_pixels: int = RANGE_PIXELS) -> DataFrame:
    """``ranking_metrics`` of packed maps and masks: ``keys..., n1, n0, auroc, ap, f1``.

    An image's scores are counted and sorted where it lies, and leave as one row of arrays per range of
    scores. A range's arrays are merged in one group; ranges' totals give each its offset. Ranges are placed
    by quantiles of some scores of every image, which sets their sizes and nothing else. No row is a pixel.
    """
    kinds = ", ".join(f"`{k}` {maps.schema[k].dataType.simpleString()}" for k in keys)
    own = maps.select(*keys, "map", "mask")
    most = own.groupBy(*keys).agg(F.sum(F.size("map")).alias("n")).agg(F.max("n")).first()[0] or 0
    n_ranges = int(min(4096, max(1, -(-most // range_pixels))))
    looked = F.transform(F.sequence(F.lit(0), F.least(F.lit(LOOKED_AT), F.size("map")) - 1), lambda i: F.element_at(F.array_sort("map"), (F.floor(i * F.size("map") / F.least(F.lit(LOOKED_AT), F.size("map"))) + 1).cast("int")))
    shares = [(i + 1) / n_ranges for i in range(n_ranges - 1)]
    at = own.where("size(map) > 0").select(*keys, F.explode(looked).alias("v")).groupBy(*keys)
    bounds = stored(at.agg((F.percentile_approx("v", shares, 10_000) if shares else F.array().cast("array<double>")).alias("bounds")), "range-bounds")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (score, mask) in _arrays(batch, ["map", "mask"]):
                value, where = np.unique(score, return_inverse=True)
                p, n = (np.bincount(where, mask == v, len(value)).astype(np.int64) for v in (1, 0))
                n += np.bincount(where, (mask != 1) & (mask != 0), len(value)).astype(np.int64)  # anything but 1 counts as 0
                # range 0 has the highest scores
                limits = np.asarray(batch.column("bounds")[i].values, float)[::-1]
                place = np.searchsorted(-limits, -value, "right")
                names, first = np.unique(-place, return_index=True)
                ends = pa.array(np.append(first, len(value)), pa.int32())
                ids = pa.array(np.full(len(names), i))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(ids) for k in keys), pa.array(-names, pa.int32()), *(pa.ListArray.from_arrays(ends, pa.array(v)) for v in (value, p, n))], names=[*keys, "r", "value", "p", "n"])

    def merge(group: pa.Table) -> pa.Table:
        value, p, n = (np.asarray(group.column(c).combine_chunks().flatten()) for c in ("value", "p", "n"))
        value, where = np.unique(-value, return_inverse=True)
        p, n = (np.bincount(where, v, len(value)).astype(np.int64) for v in (p, n))
        head = group.select([*keys, "r"]).slice(0, 1)
        for c, v in (("p", p), ("n", n)):
            head = head.append_column(c, pa.array([v], pa.list_(pa.int64())))
        return head.append_column("all_p", pa.array([int(p.sum())])).append_column("all_n", pa.array([int(n.sum())]))

    pieces = own.join(bounds, keys).mapInArrow(cut, f"{kinds}, r int, value array<double>, p array<long>, n array<long>")
    merged = stored(pieces.repartition(*keys, "r").groupBy(*keys, "r").applyInArrow(merge, f"{kinds}, r int, p array<long>, n array<long>, all_p long, all_n long"), "score-ranges")
    every = Window.partitionBy(*keys)
    before = every.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = merged.select(*keys, "r", F.coalesce(F.sum("all_p").over(before), F.lit(0)).alias("tp"), F.coalesce(F.sum("all_n").over(before), F.lit(0)).alias("fp"), F.sum("all_p").over(every).alias("n1"), F.sum("all_n").over(every).alias("n0"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            area, precision, best = [], [], []
            first = [batch.column(c).to_pylist() for c in ("tp", "fp", "n1")]
            for i, (p, n) in _arrays(batch, ["p", "n"]):
                tp, fp = first[0][i] + np.cumsum(p), first[1][i] + np.cumsum(n)
                area.append(float((n * (2 * tp - p)).sum()))
                precision.append(float((p * tp / (tp + fp)).sum()))
                f1 = 2.0 * tp / (tp + fp + first[2][i])
                best.append(float(f1[tp > 0].max()) if (tp > 0).any() else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("n1"), batch.column("n0"), pa.array(area), pa.array(precision), pa.array(best, pa.float64())], names=[*keys, "n1", "n0", "area", "precision", "best"])

    each = merged.join(offsets, [*keys, "r"]).select(*keys, "p", "n", "tp", "fp", "n1", "n0").mapInArrow(sums, f"{kinds}, n1 long, n0 long, area double, precision double, best double")
    n1, n0 = F.max("n1"), F.max("n0")
    return each.groupBy(*keys).agg(n1.alias("n1"), n0.alias("n0"), F.try_divide(F.sum("area") / 2.0, n1.cast("double") * n0.cast("double")).alias("auroc"), F.try_divide(F.sum("precision"), n1).alias("ap"), F.max("best").alias("f1"))


def pixel_metrics_packed(maps: DataFrame, keys: list[str]) -> DataFrame:
    """``pixel_metrics`` of packed maps and masks; no pixel becomes a row."""
    m = ranking_packed(maps, keys)
    area = aupro(overlap_curve_packed(maps, keys), keys)
    some = F.col("n1") > 0
    return m.join(area, keys, "left").select(*keys, *(F.when(some, F.col(a)).otherwise(0.0).alias(b) for a, b in (("auroc", "auroc_px"), ("f1", "f1_px"), ("ap", "ap_px"), ("aupro", "aupro"))))


def pixel_metrics(pixels: DataFrame, keys: list[str], image: list[str]) -> DataFrame:
    """``auroc_px, f1_px, ap_px, aupro`` per key; all 0 where no pixel is anomalous, ``auroc_px`` NULL where all are. One shuffle packs the pixels by image, and they stay packed."""
    return pixel_metrics_packed(stored(pack_pixels(pixels, keys, image), "packed-pixels"), keys)


def category_report(metrics: DataFrame) -> DataFrame:
    """All metrics times 100, one row per category and a ``mean`` row that weighs categories equally."""
    names = ["auroc_px", "f1_px", "ap_px", "aupro", "auroc_sp", "f1_sp", "ap_sp"]
    rows = metrics.select("category", *((F.col(c) * 100.0).alias(c) for c in names))
    return rows.unionByName(rows.agg(*(F.avg(c).alias(c) for c in names)).select(F.lit("mean").alias("category"), *names))
