import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from herdwise.jobs import pipelines
from herdwise.operators import graph, local, maps, metrics, scoring
from herdwise.sources import features, images, scratch, sinks


@pytest.mark.parametrize(("parts", "depth", "bad"), [(("bottle", "test", "good", "0.png"), 4, 0), (("candle", "Data", "Images", "Anomaly", "7.png"), 5, 1), (("01", "test", "ok", "3.png"), 4, 0)])
def test_inventory_reads_the_tree(spark, tmp_path, parts, depth, bad):
    file = tmp_path.joinpath(*parts)
    file.parent.mkdir(parents=True)
    file.write_bytes(b"x")
    r = images.image_inventory(spark, str(tmp_path), depth).first()
    assert (r["category"], r["anomaly_type"], r["img_name"], r["is_anomaly"]) == (parts[0], parts[-2], parts[-1], bad)


def test_consolidation_skips_class_files_and_other_items(spark):
    f = spark.createDataFrame([("visa_candle.dat", 0, 1, [1.0]), ("visa_candle.dat", 1, 1, [2.0]), ("visa_cls.dat", 0, 1, [3.0]), ("mvtec_ad_bottle.dat", 0, 1, [4.0])], "file_name string, item int, image_id long, vec array<double>")
    assert [tuple(r) for r in features.consolidate_class_features(f, "visa").collect()] == [("visa", "candle", 1, [1.0])]


def test_reports_and_maps_are_written(spark, tmp_path):
    row = ("a", *[1.0] * 7)
    r = spark.createDataFrame([("mean", *[1.0] * 7), row], "category string, " + ", ".join(f"{c} double" for c in sinks.REPORT_COLUMNS[1:]))
    sinks.write_report(r, str(tmp_path / "r"))
    assert [x["category"] for x in spark.read.option("header", "true").csv(str(tmp_path / "r")).collect()] == ["a", "mean"]
    sinks.write_maps(spark.createDataFrame([("a", "good", 1)], "category string, anomaly_type string, score int"), str(tmp_path / "m"))
    assert (tmp_path / "m" / "category=a" / "anomaly_type=good").exists()


def test_extraction_runs_the_callers_model(spark):
    def make():
        def cut(batch):
            x = np.array([list(v) for v in batch], float)
            return {3: x.reshape(len(x), 2, 2)}

        return cut

    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, [5.0, 6.0, 7.0, 8.0])], "image_id long, v array<double>")
    got = features.extract_features(df, make, [3], "v", ["image_id"], batch=1).orderBy("image_id", "patch_id").collect()
    assert [(r["image_id"], r["layer"], r["patch_id"], r["feat"]) for r in got] == [(1, 3, 0, [1.0, 2.0]), (1, 3, 1, [3.0, 4.0]), (2, 3, 0, [5.0, 6.0]), (2, 3, 1, [7.0, 8.0])]


def test_extraction_gives_image_vectors_too(spark):
    def make():
        def cut(batch):
            x = np.array([list(v) for v in batch], float)
            return {3: x.reshape(len(x), 2, 2), features.IMAGE: x[:, :1]}

        return cut

    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, [5.0, 6.0, 7.0, 8.0])], "image_id long, v array<double>")
    got = features.extract(df, make, [3], "v", ["image_id"], batch=1)
    assert [(r["image_id"], r["vec"]) for r in features.image_vectors(got).orderBy("image_id").collect()] == [(1, [1.0]), (2, [5.0])]
    assert features.patch_features(got).count() == 4


def test_feature_files_are_read_and_stored_by_category(spark, tmp_path):
    f = spark.createDataFrame([("mvtec_ad_01.dat", 0, 1, [1.0]), ("mvtec_ad_cls.dat", 0, 1, [3.0]), ("visa_a.dat", 0, 2, [4.0])], "file_name string, item int, image_id long, vec array<double>")
    f.write.partitionBy("file_name").parquet(str(tmp_path / "files"))
    f.where("file_name = 'visa_a.dat'").drop("file_name").write.parquet(str(tmp_path / "files" / "visa_b.dat"))
    read = features.read_class_features(spark, str(tmp_path / "files"))
    assert {r["file_name"] for r in read.collect()} == {"mvtec_ad_01.dat", "mvtec_ad_cls.dat", "visa_a.dat", "visa_b.dat"}
    features.write_class_store(features.consolidate_class_features(read, "mvtec"), str(tmp_path / "store"))
    assert (tmp_path / "store" / "dataset=mvtec" / "category=01").exists()
    assert [tuple(r) for r in features.read_class_store(spark, str(tmp_path / "store")).collect()] == [("mvtec", "01", 1, [1.0])]


def test_scratch_is_released_but_for_the_last(spark):
    since = scratch.mark()
    first, last = (scratch.stored(spark.range(n), "test") for n in (3, 4))
    scratch.release(spark, since, keep=1)
    assert last.count() == 4 and scratch.mark() == since + 1
    with pytest.raises(Exception, match="(?i)not.*exist|missing"):
        first.count()
    scratch.release(spark, since)


def planted(spark):
    """Two categories of 20 images of clustered patches; in 5 of each, one patch is far off."""
    rng = np.random.default_rng(8)
    rows = []
    for cat in ("a", "b"):
        centre = rng.normal(size=(4, 6)) * 3
        for i in range(20):
            x = centre + rng.normal(size=(4, 6)) * 0.05
            if i < 5:
                x[rng.integers(4)] += rng.normal(size=6) * 6
            for b in (1, 2):
                y = x if b == 1 else np.roll(x, 2, axis=1)
                rows += [(cat, 0, i, b, 0, p, p // 2, p % 2, y[p].tolist()) for p in range(4)]
    return spark.createDataFrame(rows, "category string, subset int, image_id long, backbone int, layer int, patch_id int, gy int, gx int, feat array<double>")


def test_both_detectors_find_planted_anomalies(spark):
    p = planted(spark)
    label = (F.col("image_id") < 5).cast("int").alias("is_anomaly")
    one = pipelines.pipeline_mutual(p.where("backbone = 1"), None, 4).select("category", "score", label)
    _, two = pipelines.pipeline_fused(p.where("backbone = 1"), p.where("backbone = 2"), None, 4, [1])
    for found in (one, two.select("category", "score", label)):
        assert all(r["auroc_sp"] > 0.99 for r in metrics.image_metrics(found, ["category"]).collect())


def test_scores_of_both_detectors_are_smoothed_over_the_image_graph(spark):
    p = planted(spark)
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(c, i, rng.random(3).tolist()) for c in ("a", "b") for i in range(20)], "category string, image_id long, vec array<double>")
    scores = lambda df: {(r["category"], r["image_id"]): r["score"] for r in df.collect()}
    run = lambda vectors, **kw: scores(pipelines.pipeline_fused(p.where("backbone = 1"), p.where("backbone = 2"), vectors, 4, [1], **kw)[1])
    plain = run(None)
    for dataset, k_list in (("mvtec_ad", [1, 2, 3]), ("visa", [1, 8, 9])):
        raw = spark.createDataFrame([(c, i, s) for (c, i), s in plain.items()], "category string, image_id long, score double")
        assert run(v, dataset=dataset) == pytest.approx(scores(graph.rescore_graph(v, raw, k_list, ["category"])))
    assert run(v, k_list=[0]) == pytest.approx(plain) and run(v) != pytest.approx(plain)


def test_a_restarted_detector_reads_what_is_finished(spark, tmp_path):
    p = planted(spark)
    at = f"{tmp_path}/job"
    run = lambda rows: {(r["category"], r["image_id"]): r["score"] for r in pipelines.pipeline_fused(rows.where("backbone = 1"), rows.where("backbone = 2"), None, 4, [1], restart=at)[1].collect()}
    first = run(p)
    names = {x.name for x in (tmp_path / "job").iterdir()}
    assert {"aggregated", "first-maps", "pseudo-normal", "references", "weights", "maps"} <= names
    assert run(p.where("image_id < 0")) == first  # nothing was computed again
    for name in ("maps", "weights"):  # a driver that failed there
        (tmp_path / "job" / name / "_SUCCESS").unlink()
    assert run(p) == pytest.approx(first)


def test_features_of_a_fused_detector_are_shuffled_once(spark, tmp_path):
    p = planted(spark)
    p.write.parquet(f"{tmp_path}/patches")
    p = spark.read.parquet(f"{tmp_path}/patches")
    packed = local.pack_images([p.where("backbone = 1"), p.where("backbone = 2")], ["category", "subset", "layer", "image_id"])
    z = local.aggregate_packed(packed, [1, 3], ["category", "subset", "layer", "image_id"])
    plan = z._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange") == 1
    z.write.parquet(f"{tmp_path}/z")
    z = spark.read.parquet(f"{tmp_path}/z")
    assert z.count() == 2 * 40 and {r["n"] for r in z.select("n").collect()} == {2 * 4 * 6}
    w = spark.createDataFrame([("a", 0, 0, 1, 0.5, 0.5)], "category string, subset int, layer int, degree int, w1 double, w2 double")
    fused = scoring.fused_packed(z, z.where("image_id > 15"), w, ["category", "subset", "layer", "degree"], ["category", "subset", "layer", "degree"])
    plan = fused._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert all("flat" not in line for line in plan.splitlines() if "Exchange" in line)


def cut_bytes(shift):
    """A stand-in for a backbone that reads a file: its first 36 bytes, as patches of four numbers."""

    def extract(contents):
        x = np.stack([np.roll(np.frombuffer(c[:36], np.uint8).astype(float), shift) for c in contents]).reshape(len(contents), 9, 4)
        return {0: x, 2: x[:, ::-1], "image": x.mean(1)}

    return lambda: extract


def test_from_a_tree_to_a_report(spark, tmp_path):
    rng = np.random.default_rng(4)
    masks = []
    for cat in ("a", "b"):
        base = rng.integers(60, 200, 36)
        for i in range(24):
            kind = "good" if i >= 6 else "broken"
            x = base + rng.integers(-3, 4, 36)
            mask = np.zeros((6, 6), int)
            if kind == "broken":
                x[12:16] = rng.integers(0, 50, 4)  # the patch in the middle row, left
                mask[2:4, 0:2] = 1
            path = tmp_path / "tree" / cat / "test" / kind / f"{i}.png"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(x.astype(np.uint8).tobytes())
            masks.append((f"file:{path}", mask.ravel().tolist()))
    known = spark.createDataFrame(masks, "path string, mask array<int>")
    found = pipelines.detect_tree(spark, f"{tmp_path}/tree", (cut_bytes(0), cut_bytes(1)), [0, 2], 6, f"{tmp_path}/report", known, restart=f"{tmp_path}/job", r_list=[1], k_list=[0])
    assert found.count() == 48 and found.where("is_anomaly = 1").count() == 12
    report = {r["category"]: r for r in spark.read.option("header", "true").option("inferSchema", "true").csv(f"{tmp_path}/report").collect()}
    assert set(report) == {"a", "b", "mean"}
    assert all(r["auroc_sp"] > 95 and 0 < r["ap_px"] <= 100 for r in report.values())
    packed = found.select("image_id", "map")
    rows = packed.select("image_id", F.posexplode("map").alias("x", "score")).withColumn("y", F.lit(0))
    for a, b, c in ((maps.binary_mask_packed(packed), maps.binary_mask(rows, ["image_id"]), "binary"), (maps.heat_levels_packed(packed), maps.heat_levels(rows, ["image_id"]), "level"), (maps.heat_levels_packed(packed, "whole_norm"), maps.heat_levels(rows, ["image_id"], "whole_norm"), "level")):
        want = {(r["image_id"], r["x"]): r[c] for r in b.collect()}
        assert {(r["image_id"], i): v for r in a.collect() for i, v in enumerate(r[c])} == want


def test_the_entry_point_and_its_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def shuffle_bytes(spark):
    """Of shuffle files on the disk of this (local) session."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_a_written_table_leaves_no_shuffle_behind(spark):
    before, set_ = shuffle_bytes(spark), spark.conf.get(scratch.CLEANUP, None)
    made = scratch.stored(spark.range(100_000).groupBy((F.col("id") % 30_000).alias("k")).agg(F.count("*").alias("n")), "counted")
    assert shuffle_bytes(spark) <= before and spark.conf.get(scratch.CLEANUP, None) == set_
    assert made.where("n >= 3").count() == 30_000
