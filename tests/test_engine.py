"""Whole tasks through the engine's verbs, plug-in models and streams."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraframe.api import Engine
from terraframe.operators import adapters, raster_ops
from terraframe.operators.adapters import Adapter, detect
from terraframe.sources import catalog, npz, scenes, tiff
from terraframe.streaming import scenes as streams


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, str(tmp_path_factory.mktemp("jobs")))


def test_indices_analysis_and_report(spark, engine):
    pixels = spark.range(80).select(F.floor(F.col("id") / 10).alias("y"), (F.col("id") % 10).alias("x"), F.lit(0.0).alias("b"), F.lit(0.0).alias("g"), F.lit(20.0).alias("r"), F.lit(60.0).alias("n"))
    record = engine.run_spectral_indices(pixels, ["ndvi"], thresholds={"dense": ">0.3"}, transform=(2, 0, 0, 0, -2, 0))
    assert record["statistics"]["ndvi_mean"] == 0.5 and record["statistics"]["ndvi_areas"]["dense"] == {"pixel_count": 80, "area_m2": 320, "area_km2": 320 / 1e6}
    with pytest.raises(ValueError):
        engine.run_spectral_indices(pixels, ["mndwi"])
    assert "## 结论" in open(engine.report(record["job_id"]), encoding="utf-8").read()


def test_change_needs_alignment_or_resampling(spark, engine):
    before, after = scenes.synthetic(spark, 30, 20, 3), scenes.synthetic(spark, 30, 20, 3, changed=True)
    record = engine.run_change_detection(before, after, ["b1", "b2", "b3"], threshold=0.2)
    assert record["statistics"]["changed_pixels"] > 0
    small = scenes.synthetic(spark, 15, 10, 3)
    with pytest.raises(ValueError):
        engine.run_change_detection(before, small, ["b1"], sizes=((20, 30), (10, 15)))
    record = engine.run_change_detection(before, small, ["b1"], sizes=((20, 30), (10, 15)), auto_align=True)
    assert record["statistics"]["total_pixels"] == 600 and record["quality_flags"][0]["code"] == "alignment_shape_mismatch"


def test_detection_segmentation_super_resolution(spark, engine):
    class Bright(Adapter):
        def predict(self, tile, info):
            rows, columns = np.nonzero(tile.mean(axis=0) > 200)
            if len(rows):
                yield {"label": "bright", "score": 0.9, "bbox": [columns.min(), rows.min(), columns.max() + 1, rows.max() + 1]}

    pixels = scenes.visual_synthetic(spark, 60, 48, 3).withColumns({b: F.when((F.col("x") >= 5) & (F.col("x") < 18) & (F.col("y") >= 4) & (F.col("y") < 16), 230).otherwise(F.col(b)) for b in ("b1", "b2", "b3")})
    found = engine.run_detection(pixels, ["b1", "b2", "b3"], (60, 48), tile=32, overlap=8, iou=0.5)
    assert found["statistics"]["count"] >= 1
    plug = detect(pixels, ["b1", "b2", "b3"], (60, 48), Bright, tile=64, overlap=0).collect()
    assert [r.bbox for r in plug] == [[5, 4, 18, 16]]
    assert engine.run_semantic_segmentation(pixels, ["b1", "b2", "b3"])["statistics"]["connected_component_count"] > 0
    image = engine.run_super_resolution(pixels, 2, (2, 0, 0, 0, -2, 0))
    assert spark.read.parquet(image["outputs"]["image"]).count() == 4 * 60 * 48
    assert engine.preflight(100, 70, "x", 32, 8)["tile_count"] == 12 and len(engine.list_models()) == 6


def test_oriented_and_instance_outputs(spark, engine):
    pixels = scenes.visual_synthetic(spark, 60, 48, 3).withColumns({b: F.when((F.col("x") >= 5) & (F.col("x") < 18) & (F.col("y") >= 4) & (F.col("y") < 16), 230).otherwise(F.col(b)) for b in ("b1", "b2", "b3")})
    bands, t = ["b1", "b2", "b3"], (2, 0, 100, 0, -2, 200)
    turned = engine.run_detection(pixels, bands, (60, 48), task="oriented_detection", tile=32, overlap=8, transform=t)
    rows = spark.read.parquet(turned["outputs"]["detections"]).collect()
    assert rows and all(r.angle_degrees == 25 and r.rotated[4] == 25 and len(r.ring) == 5 and r.label.startswith("oriented_") for r in rows)
    for r in rows:
        assert r.bbox == [min(p.x for p in r.polygon), min(p.y for p in r.polygon), max(p.x for p in r.polygon), max(p.y for p in r.polygon)]
        assert np.allclose([(p.x, p.y) for p in r.ring], [(2 * p.x + 100, -2 * p.y + 200) for p in r.polygon])
    found = engine.run_detection(pixels, bands, (60, 48), task="instance_segmentation", tile=64, overlap=0, transform=t)
    stored = spark.read.parquet(found["outputs"]["detections"]).collect()
    mask = spark.read.parquet(found["outputs"]["instance_mask"])
    assert sorted(r.instance for r in mask.select("instance").distinct().collect()) == list(range(1, len(stored) + 1)) and mask.count() == sum(r.area_pixels for r in stored)
    assert sorted(r.instance_id for r in stored) == list(range(1, len(stored) + 1))
    body = json.load(open(found["outputs"]["geojson"], encoding="utf-8"))
    assert len(body["features"]) == len(stored) and body["features"][0]["properties"]["label"] == stored[0].label
    done = engine.analyze(found["job_id"])
    assert done["statistics"]["instance_count"] == len(stored) and done["conclusion"]["key_findings"][0] == f"目标数量：{len(stored)}" and done["conclusion"]["confidence"] in ("high", "medium", "low")
    by_file = engine.calculate_statistics(job_id=found["job_id"], zones="z.geojson")
    assert by_file["statistics"]["feature_count"] == len(stored) and by_file["quality_flags"][0]["code"] == "zonal_stats_not_run"


def test_every_task_is_analysed_anew(spark, engine):
    pixels, later = scenes.synthetic(spark, 30, 20, 4), scenes.synthetic(spark, 30, 20, 4, changed=True)
    bands = ["b1", "b2", "b3", "b4"]
    classes = engine.analyze(engine.run_semantic_segmentation(pixels, bands, area=4.0)["job_id"])
    assert abs(sum(classes["statistics"]["class_ratios"].values()) - 1) < 1e-9 and classes["conclusion"]["key_findings"][0].startswith("类别占比：")
    change = engine.analyze(engine.run_change_detection(pixels, later, bands, area=2.0)["job_id"])
    assert change["statistics"]["changed_area_m2"] == 2 * change["statistics"]["changed_pixels"] and "变化面积占比" in change["conclusion"]["key_findings"][0]
    image = engine.analyze(engine.run_super_resolution(pixels, 2, (2, 0, 0, 0, -2, 0), size=(30, 20))["job_id"])
    assert image["statistics"]["shape_matches_scale"] and image["statistics"]["transform_matches_scale"]
    index = engine.analyze(engine.run_spectral_indices(pixels, ["ndvi"])["job_id"])
    assert index["statistics"]["indices"]["ndvi"]["total_pixels"] == 600 and "0.0000" in index["conclusion"]["summary"]
    mask = engine.calculate_statistics(job_id=change["job_id"])
    assert [b["total_pixels"] for b in mask["statistics"]["bands"]] == [600, 600]
    with pytest.raises(ValueError):
        engine.calculate_statistics()


def test_requests_are_checked_before_they_run(spark, engine):
    pixels = scenes.synthetic(spark, 8, 8, 3)
    for call in (lambda: engine.run_detection(pixels, ["b1"], (8, 8), iou=1.5), lambda: engine.run_detection(pixels, ["b1"], (8, 8), tile=8, overlap=8), lambda: engine.run_change_detection(pixels, pixels, ["b1"], threshold=-1), lambda: engine.run_super_resolution(pixels, 0)):
        with pytest.raises(ValueError):
            call()
    assert engine.preflight(2048, 1200, "detection")["overlap"] == 192 and engine.preflight(2048, 1200, "segmentation")["overlap"] == 128


MODELS = """models:
  - {id: far_subprocess, task: object_detection, backend: fake, runner: subprocess, entrypoint: terraframe.operators.worker, runner_timeout_sec: 60}
  - {id: far_subprocess, task: object_detection, backend: fake}
  - {id: classes_apart, task: semantic_segmentation, backend: x, runner: subprocess, entrypoint: terraframe.operators.worker}
  - {id: change_apart, task: change_detection, backend: x, runner: subprocess, entrypoint: terraframe.operators.worker}
  - {id: image_apart, task: super_resolution, backend: x, runner: subprocess, entrypoint: terraframe.operators.worker}
  - {id: none, task: object_detection, backend: x, runner: subprocess, entrypoint: no.such.module}
  - {id: later, task: object_detection, backend: fake, runner: http}
  - {id: real, task: object_detection, backend: ultralytics}
"""


def test_models_in_their_own_process(spark, tmp_path):
    (tmp_path / "m.yaml").write_text(MODELS)
    engine = Engine(spark, str(tmp_path / "jobs"), str(tmp_path / "m.yaml"))
    pixels = scenes.synthetic(spark, 20, 16, 3).withColumn("b1", F.when((F.col("x") == 9) & (F.col("y") == 7), 255).otherwise(F.col("b1")))
    found = engine.run_detection(pixels, ["b1", "b2", "b3"], (20, 16), tile=32, overlap=0, model_id="far_subprocess")
    assert found["statistics"]["count"] == 1 and found["model_id"] == "far_subprocess"
    mask = engine.run_semantic_segmentation(pixels, ["b1", "b2", "b3"], size=(20, 16), tile=12, overlap=4, model_id="classes_apart")
    assert spark.read.parquet(mask["outputs"]["mask"]).count() == 320
    change = engine.run_change_detection(pixels, scenes.synthetic(spark, 20, 16, 3, changed=True), ["b1"], sizes=((16, 20), (16, 20)), tile=32, overlap=0, model_id="change_apart")
    assert change["statistics"]["changed_pixels"] > 0
    image = engine.run_super_resolution(pixels, 2, size=(20, 16), tile=12, overlap=4, model_id="image_apart")
    back = {(r.y, r.x): r.b2 for r in spark.read.parquet(image["outputs"]["image"]).collect()}
    assert len(back) == 4 * 320 and all(back[2 * r.y + 1, 2 * r.x] == r.b2 for r in pixels.collect())
    with pytest.raises(Exception, match="no.such.module"):
        engine.run_detection(pixels, ["b1"], (20, 16), tile=32, overlap=0, model_id="none")
    assert engine.jobs.list()[0]["status"] in ("failed", "success") and any(j["status"] == "failed" for j in engine.jobs.list())
    with pytest.raises(NotImplementedError):
        engine.run_detection(pixels, ["b1"], (20, 16), model_id="later")
    with pytest.raises(catalog.BackendUnavailable):
        engine.run_detection(pixels, ["b1"], (20, 16), model_id="real")


def test_models_are_loaded_and_closed_by_task(spark, tmp_path):
    class Noted(Adapter):
        def load(self):
            self.file = open(tmp_path / f"{os.getpid()}-{id(self)}", "w")  # noqa: SIM115
            self.file.write("load ")

        def predict(self, tile, info):
            self.file.write("tile ")
            return [{"score": 0.5, "bbox": [0, 0, 1, 1], "polygon": [(0, 0), (1, 0), (1, 1)]}]

        def close(self):
            self.file.write("close")
            self.file.close()

    pixels = scenes.synthetic(spark, 20, 16, 1)
    rows = detect(pixels, ["b1"], (20, 16), Noted, tile=8, overlap=0).collect()
    said = [p.read_text().split() for p in tmp_path.iterdir()]
    assert len(rows) == 6 and all(s[0] == "load" and s[-1] == "close" for s in said) and sum(s.count("tile") for s in said) == 6
    assert all((p.x - q.x, p.y - q.y) == (0, 0) for r in rows for p, q in [(r.polygon[0], type(r.polygon[0])(x=r.bbox[0], y=r.bbox[1]))])


def test_inspect(spark, engine, tmp_path):
    path = str(tmp_path / "s.npz")
    npz.write_scene(scenes.synthetic(spark, 8, 6, 2), path, 8, 6, "uint8", crs=None)
    assert engine.inspect(path)["warning"] == "no CRS"
    with pytest.raises(FileNotFoundError):
        engine.inspect(path + "x")


def test_stream_totals(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = spark.createDataFrame([("a", 20.0, 60.0), ("a", 0.0, 0.0), ("b", 60.0, 20.0)], "raster_id string, red double, nir double")
    rows.write.parquet(folder)
    stream = streams.pixel_stream(spark, folder, "raster_id string, red double, nir double")
    query = streams.write_totals(streams.index_totals(stream, "ndvi", {"red": "red", "nir": "nir"}), "totals", os.path.join(tmp_path, "ck"))
    query.awaitTermination(120)
    assert {r.raster_id: (r.valid_pixels, r.mean) for r in spark.table("totals").collect()} == {"a": (1, 0.5), "b": (1, -0.5)}


def test_super_resolution_against_a_reference(spark, engine):
    pixels = scenes.synthetic(spark, 12, 9, 2)
    exact = raster_ops.upscale(pixels, 2)
    alone = engine.run_super_resolution(pixels, 2)
    assert [f["code"] for f in alone["quality_flags"]] == ["no_reference_image"] and not alone["statistics"]["reference_metrics_available"]
    same = engine.run_super_resolution(pixels, 2, reference=exact)["statistics"]
    assert same["psnr"] == float("inf") and same["ssim"] == pytest.approx(1) and same["reference_shape"] == [18, 24]
    rows = {(r.y, r.x): (r.b1, r.b2) for r in exact.collect()}
    off = exact.withColumn("b1", F.col("b1") + 10)
    found = engine.run_super_resolution(pixels, 2, reference=off)
    assert found["statistics"]["psnr"] == pytest.approx(20 * np.log10(255) - 10 * np.log10(50)) and [f["message"] for f in found["quality_flags"]] == ["lpips_unavailable"]
    small = engine.run_super_resolution(pixels, 2, reference=pixels.select("y", "x", (F.col("b1") + 3).alias("b1")))  # brought to the result's grid
    place = lambda i, n, m: int(np.rint(i * ((m - 1) / (n - 1))))
    own = {(r.y, r.x): r.b1 for r in pixels.collect()}
    error = np.mean([(own[place(y, 18, 9), place(x, 24, 12)] + 3 - b[0]) ** 2 for (y, x), b in rows.items()])
    assert small["statistics"]["psnr"] == pytest.approx(20 * np.log10(255) - 10 * np.log10(error)) and small["statistics"]["reference_shape"] == [9, 12]
    assert "the first 1 compared" in small["quality_flags"][0]["message"]


def test_quality_checks_of_files_and_jobs(spark, engine, tmp_path):
    scene = scenes.synthetic(spark, 8, 6, 1)
    npz.write_scene(scene, str(tmp_path / "s.npz"), 8, 6, "uint8", crs=None)
    tiff.write_scene(scene, str(tmp_path / "s.tif"), 8, 6, "uint8", "EPSG:3857")
    codes = lambda record: [f["code"] for f in record["quality_flags"]]
    assert codes(engine.check_quality(str(tmp_path / "s.npz"))) == ["crs_missing", "fallback_raster_io"] and codes(engine.check_quality(str(tmp_path / "s.tif"))) == []
    assert codes(engine.check_quality(str(tmp_path / "none.tif"))) == ["missing_outputs", "raster_read_failed"]
    (tmp_path / "text.tif").write_text("no raster")
    assert codes(engine.check_quality(str(tmp_path / "text.tif"))) == ["raster_read_failed"]
    job = engine.run_detection(scene, ["b1"], (8, 6), tile=8, overlap=0, score=1.0)
    found = engine.check_quality(job_id=job["job_id"])
    assert codes(found) == ["empty_result", "empty_result"] and found["statistics"] == {"flag_count": 2, "error_count": 0} and os.path.exists(found["outputs"]["quality_json"])
    os.remove(job["outputs"]["geojson"])
    assert engine.check_quality(job_id=job["job_id"])["statistics"]["error_count"] == 1
    with pytest.raises(ValueError):
        engine.check_quality()


def test_class_map_by_path(spark, engine, tmp_path):
    (tmp_path / "c.yaml").write_text("classes:\n  0: {name: ground}\n")
    found = engine.run_semantic_segmentation(scenes.synthetic(spark, 8, 6, 3), ["b1", "b2", "b3"], names=str(tmp_path / "c.yaml"))
    assert "ground" in found["statistics"]["class_ratios"]
    with pytest.raises(FileNotFoundError):
        engine.run_semantic_segmentation(scenes.synthetic(spark, 8, 6, 3), ["b1"], names=str(tmp_path / "none.yaml"))


PLUGIN = """import numpy as np
from terraframe.operators.adapters import Adapter

class Brightest(Adapter):
    def __init__(self, model):
        self.label, self.least = model["label"], model["confidence_threshold"]

    def predict(self, tile, info):
        y, x = np.unravel_index(tile[0].argmax(), tile[0].shape)
        yield {"label": self.label, "score": max(0.5, self.least), "bbox": (x, y, x + 1, y + 1)}
"""


def test_models_that_name_their_adapter(spark, tmp_path):
    (tmp_path / "brightest_plugin.py").write_text(PLUGIN)
    spark.sparkContext.addPyFile(str(tmp_path / "brightest_plugin.py"))
    (tmp_path / "m.yaml").write_text("""models:
  - {id: own, task: object_detection, backend: python, entrypoint: "brightest_plugin:Brightest", label: top}
  - {id: gone, task: object_detection, backend: python, entrypoint: "no_such_plugin.at_all:Brightest"}
  - {id: bare, task: object_detection, backend: python}
  - {id: noted, task: object_detection, backend: house}
""")
    engine = Engine(spark, str(tmp_path / "jobs"), str(tmp_path / "m.yaml"))
    pixels = scenes.synthetic(spark, 20, 16, 1).withColumn("b1", F.when((F.col("x") == 9) & (F.col("y") == 7), 255).otherwise(F.col("b1") % 200))
    found = engine.run_detection(pixels, ["b1"], (20, 16), tile=32, overlap=0, model_id="own")
    (row,) = spark.read.parquet(found["outputs"]["detections"]).collect()
    assert (row.label, row.bbox, found["model_id"]) == ("top", [9.0, 7.0, 10.0, 8.0], "own")
    with pytest.raises(catalog.BackendUnavailable):
        engine.run_detection(pixels, ["b1"], (20, 16), model_id="gone")
    with pytest.raises(ValueError, match="entrypoint"):
        engine.run_detection(pixels, ["b1"], (20, 16), model_id="bare")
    with pytest.raises(catalog.BackendUnavailable):
        engine.run_detection(pixels, ["b1"], (20, 16), model_id="noted")

    class Nothing(Adapter):
        def predict(self, tile, info):
            return []

    try:
        adapters.backend("object_detection", "House")(lambda model: Nothing())
        assert engine.run_detection(pixels, ["b1"], (20, 16), tile=32, overlap=0, model_id="noted")["statistics"]["count"] == 0
    finally:
        adapters.BACKENDS.clear()
