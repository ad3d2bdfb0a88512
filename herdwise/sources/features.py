"""Feature tables: extraction with a caller's model, and consolidation of per-category files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Given a matrix or list of inputs: for each layer an array [inputs, patches, channels], and under ``IMAGE`` one vector for each input.
Extractor = Callable[[list], dict[int | str, np.ndarray]]
IMAGE = "image"

#: Prefix of a dataset's file names, and the suffix.
PREFIXES = {"mvtec": "mvtec_ad_", "visa": "visa_"}
STORE_SCHEMA = "image_id long, vec array<double>, dataset string, category string"


def _lists(values: pa.Array, each: int, n: int) -> pa.ListArray:
    """``n`` lists of ``each`` neighbouring values, on the same buffer."""
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * each), values)


def extract(images: DataFrame, make_extractor: Callable[[], Extractor], layers: list[int], input_col: str, id_cols: list[str], backbone: int = 1, batch: int = 64) -> DataFrame:
    """One row per image: the id columns, ``backbone``, ``tokens`` (its patch vectors at the chosen layers) and ``vec``, its image vector (null without one).

    ``make_extractor`` is called once per task, so a model is loaded once; images are handed over
    ``batch`` at a time and leave one by one, as lists on the model's own numbers (as doubles). Store the result: the patch and vector tables both come
    from it, and everything later restarts there.
    """
    schema = ", ".join([*(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in id_cols), "backbone int", "tokens array<struct<layer:int,patches:array<array<double>>>>", "vec array<double>"])

    def tokens(own: list[np.ndarray]) -> pa.ListArray:
        """One image's layers as one list."""
        patches = [_lists(pa.array(np.asarray(x, np.float64).ravel()), x.shape[1], x.shape[0]) for x in own]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
        by_layer = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(patches) if patches else pa.array([], pa.list_(pa.float64())))
        return _lists(pa.StructArray.from_arrays([pa.array(layers, pa.int32()), by_layer], names=["layer", "patches"]), len(layers), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_extractor()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                got = model(part.column(input_col).to_pylist())
                for i in range(part.num_rows):
                    vec = pa.array([np.asarray(got[IMAGE][i], np.float64) if IMAGE in got else None], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*(part.column(c).slice(i, 1) for c in id_cols), pa.array([backbone], pa.int32()), tokens([np.asarray(got[layer][i]) for layer in layers]), vec], names=[*id_cols, "backbone", "tokens", "vec"])

    return images.select(*id_cols, input_col).mapInArrow(run, schema)


def patch_features(extracted: DataFrame) -> DataFrame:
    """The patch vectors of an extraction: the id columns, ``backbone, layer, patch_id, feat``; there is no CLS row."""
    ids = [c for c in extracted.columns if c not in ("tokens", "vec")]
    at = extracted.select(*ids, F.explode("tokens").alias("t")).select(*ids, "t.layer", F.posexplode("t.patches").alias("patch_id", "feat"))
    return at.select(*ids, "layer", "patch_id", "feat")


def image_vectors(extracted: DataFrame) -> DataFrame:
    """The image vectors of an extraction: the id columns, ``backbone, vec``. Images without one are left out."""
    return extracted.where("vec is not null").drop("tokens")


def extract_features(images: DataFrame, make_extractor: Callable[[], Extractor], layers: list[int], input_col: str, id_cols: list[str], backbone: int = 1, batch: int = 64) -> DataFrame:
    """Only the patch vectors of every image at the chosen layers."""
    return patch_features(extract(images, make_extractor, layers, input_col, id_cols, backbone, batch))


def read_class_features(spark: SparkSession, root: str) -> DataFrame:
    """``file_name, item, image_id, vec`` of all feature files under ``root``.

    A file may be a single Parquet file or a folder that Spark wrote (``<name>.dat/part-...``, or ``file_name=<name>.dat/part-...``): the folder's name counts.
    """
    files = spark.read.option("recursiveFileLookup", "true").schema("item int, image_id long, vec array<double>").parquet(root)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+?)(/part-[^/]*)?$", 1)
    return files.select(name.alias("file_name"), "item", "image_id", "vec")


def consolidate_class_features(files: DataFrame, dataset: str) -> DataFrame:
    """One store ``dataset, category, image_id, vec`` out of per-category feature files.

    ``files`` has ``file_name, item, image_id, vec``. Files whose name holds the dataset
    and not ``cls`` are kept; the category is the name without prefix and ``.dat``; of each
    file only the first item (0) is used.
    """
    prefix = PREFIXES.get(dataset, dataset + "_")
    name = F.col("file_name")
    category = F.replace(F.replace(name, F.lit(prefix), F.lit("")), F.lit(".dat"), F.lit(""))
    return files.where(name.contains(dataset) & ~name.contains("cls") & (F.col("item") == 0)).select(F.lit(dataset).alias("dataset"), category.alias("category"), "image_id", "vec")


def write_class_store(store: DataFrame, path: str) -> None:
    """The store as Parquet, a folder per dataset and category, so that readers of one category read that alone."""
    store.write.mode("overwrite").partitionBy("dataset", "category").parquet(path)


def read_class_store(spark: SparkSession, path: str) -> DataFrame:
    """A written store; names that look like numbers stay text."""
    return spark.read.schema(STORE_SCHEMA).parquet(path).select("dataset", "category", "image_id", "vec")
