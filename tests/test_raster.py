"""Operators on small literal inputs, and the errors they raise before any work is done."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraframe.functions import affine, geometry, indices, tiles
from terraframe.operators import components, graph, jobs, nms, quality, ranks, raster_ops, statistics, stitching
from terraframe.plans import registry
from terraframe.sources import catalog, features, npz, scenes


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0]


def test_tiles_shrink_and_shift(spark):
    shrunk = tiles.grid(spark, 100, 70, 32, 8, edge="shrink").orderBy("tile_seq").collect()
    assert (shrunk[0].tile_id, shrunk[0].x1, shrunk[0].y1) == ("r0000_c0000", 32, 32)
    last = shrunk[-1]
    assert (last.x0, last.y0, last.x1 - last.x0, last.y1 - last.y0) == (72, 48, 28, 22)
    shifted = tiles.grid(spark, 100, 80, 32, 8).orderBy("tile_seq").collect()
    assert (shifted[-1].x0, shifted[-1].y0, shifted[-1].x1, shifted[-1].y1) == (68, 48, 100, 80)
    with pytest.raises(ValueError):
        tiles.grid(spark, 100, 100, 32, 32)
    plan = one(tiles.preflight(spark, 2048, 1200, "super_resolution"))
    assert (plan.tile_size, plan.overlap, plan.tile_count, plan.windows_truncated) == (256, 32, 54, True)


@pytest.mark.parametrize(("length", "tile", "overlap"), [(10, 32, 8), (32, 32, 8), (33, 32, 8), (100, 32, 8), (97, 16, 15)])
def test_pixels_are_in_the_tiles_that_hold_them(spark, length, tile, overlap):
    pixels = spark.range(length).select(F.col("id").alias("x"), F.lit(0).cast("long").alias("y"))
    found = {(r.x, r.tile_x0) for r in tiles.assign(pixels, length, 1, tile, overlap).collect()}
    starts = [r.x0 for r in tiles.grid(spark, length, 1, tile, overlap).collect()]
    assert found == {(x, s) for s in starts for x in range(s, min(s + tile, length))}


def test_overlap_is_blended(spark):
    rows = spark.createDataFrame([(x, 0, 1.0) for x in range(4)] + [(x, 2, 3.0) for x in range(2, 6)], "x int, x0 int, v double")
    weight = stitching.centre_weight(F.col("x") - F.col("x0"), F.lit(0), F.lit(4), F.lit(1))
    found = {r.x: r.v for r in stitching.stitch(rows, "v", ["x"], weight).collect()}
    assert found[0] == 1 and found[5] == 3 and math.isclose(found[2], 5 / 3)


def test_suppression_keeps_the_best_and_the_boxless(spark):
    rows = [("s", "a", 0.9, [0.0, 0.0, 10.0, 10.0]), ("s", "b", 0.8, [1.0, 1.0, 11.0, 11.0]), ("s", "c", 0.7, [20.0, 20.0, 30.0, 30.0]), ("s", "d", 0.1, None)]
    records = spark.createDataFrame(rows, "raster_id string, id string, score double, bbox array<double>")
    kept = nms.suppress(records, 0.5, [F.desc("score"), F.asc("id")])
    assert sorted(r.id for r in kept.collect()) == ["a", "c", "d"]
    assert nms.suppress(records.limit(0), 0.5, [F.desc("score")]).count() == 0


def test_components_of_an_empty_and_a_ring_mask(spark):
    ring = [(y, x) for y in range(5) for x in range(5) if y in (0, 4) or x in (0, 4)] + [(2, 2)]
    found = components.numbered(components.components(spark.createDataFrame(ring, "y int, x int"))).orderBy("component_id").collect()
    assert [(r.pixel_count, r.x0, r.y0, r.x1, r.y1) for r in found] == [(16, 0, 0, 5, 5), (1, 2, 2, 3, 3)]
    assert components.components(spark.createDataFrame([], "y int, x int")).count() == 0


def test_affine_and_boxes(spark):
    t = affine.transform((2, 0, 1000, 0, -3, 2000, 0, 0, 1))
    box = geometry.translate_box(F.array(*map(F.lit, (10.0, 20.0, 30.0, 40.0))), F.lit(100), F.lit(50))
    ring = geometry.to_geo(geometry.box_polygon(box), t)
    r = one(spark.range(1).select(box.alias("b"), ring.alias("p"), affine.scaled(affine.transform((4, 0, 100, 0, -6, 200)), 2).alias("s")))
    assert r.b == [110, 70, 130, 90] and tuple(r.p[0]) == (1220, 1790) == tuple(r.p[-1]) and tuple(r.s) == (2, 0, 100, 0, -3, 200)
    with pytest.raises(ValueError):
        affine.scaled(t, 0)


def test_indices_with_nodata_and_zero_denominators(spark):
    rows = spark.createDataFrame([(20.0, 60.0), (0.0, 0.0), (-9999.0, 60.0), (None, 1.0)], "red double, nir double")
    bands = {n: indices.without_nodata(F.col(n), -9999.0) for n in ("red", "nir")}
    assert [r.v for r in rows.select(indices.index("ndvi", bands).alias("v")).collect()] == [0.5, None, None, None]
    with pytest.raises(ValueError, match="swir1"):
        indices.validate(["mndwi"], indices.resolve_bands(4), 4)
    with pytest.raises(ValueError):
        indices.resolve_bands(4, {"thermal": 1})
    assert list(indices.thresholds(0.3)) == [">0.3"] and list(indices.thresholds([">= 1"])) == [">= 1"]
    (empty,), _ = statistics.summaries(rows.limit(0).select(indices.index("ndvi", bands).alias("v")), ["v"])
    assert empty["valid_pixels"] == 0 and empty["mean"] == 0


def test_segmentation_and_change_statistics(spark):
    block = [(y, x, int(2 <= y < 5 and 3 <= x < 7)) for y in range(10) for x in range(10)]
    rows = spark.createDataFrame(block, "y int, x int, class_id int")
    found = {r.class_id: r for r in statistics.segmentation(rows, 4.0).collect()}
    assert found[1].area_m2 == 48 and found[1].ratio == 0.12 and sum(r.component_count for r in found.values()) == 2
    changed = one(statistics.change(rows.withColumnRenamed("class_id", "changed"), 4.0))
    assert changed.changed_area_m2 == 48 and changed.change_area_ratio == 0.12
    none = one(statistics.change(rows.limit(0).withColumnRenamed("class_id", "changed"), 4.0))
    assert none.changed_pixels == 0 and none.max_patch_area_m2 == 0


def test_equal_images_have_infinite_psnr(spark):
    rows = spark.createDataFrame([(0, 1.0, 1.0), (0, 200.0, 200.0)], "band int, a double, b double")
    assert one(raster_ops.psnr(rows, "a", "b")).psnr == math.inf
    assert math.isclose(one(raster_ops.ssim(rows, "band", "a", "b")).ssim, 1)


def test_rules_and_confidence(spark):
    job = [("j", True, None, 0, 0.6, 0.4, 10, 8, 512, 8)]
    facts = spark.createDataFrame(job, "job_id string, has_crs_key boolean, crs string, target_count long, low_confidence_ratio double, edge_object_ratio double, connected_component_count long, small_patch_count long, tile_size int, overlap int")
    flags = quality.run_checks(facts)
    assert [r.code for r in flags.orderBy("seq").collect()] == ["no_crs_warning", "empty_result_warning", "too_many_small_polygons_warning", "low_confidence_warning", "edge_object_ratio_warning", "tile_seam_risk_warning"]
    assert one(quality.confidence(flags)).confidence == "low"


def test_jobs_record_success_and_failure(tmp_path):
    store = jobs.JobStore(str(tmp_path))
    done = store.submit("quality", lambda folder: jobs.build_manifest("quality", folder, {"a": "x.tif"}, {"o": "y"}, {}, {"n": 1}))
    manifest = json.loads(open(done["manifest_path"]).read())
    assert done["status"] == "success" and manifest["stats"] == manifest["statistics"] == {"n": 1} and manifest["input_files"] == ["x.tif"]
    with pytest.raises(RuntimeError):
        store.submit("quality", lambda folder: (_ for _ in ()).throw(RuntimeError("no")))
    (tmp_path / "broken.json").write_text("{")
    assert sorted(r["status"] for r in store.list()) == ["failed", "success"]


def test_models_fall_back_and_refuse():
    models = catalog.Models()
    assert models.resolve("object_detection", "no_such")["id"] == "fake_detection"
    assert models.resolve("object_detection", "fake_change", score=None)["id"] == "fake_detection"
    with pytest.raises(catalog.BackendUnavailable):
        models.check({"id": "x", "backend": "yolo"})
    with pytest.raises(NotImplementedError):
        models.check({"id": "x", "backend": "fake", "runner": "http"})


def test_features_and_scenes_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("ship", 0.9, [0.0, 0.0, 10.0, 10.0]), ("ship", 0.4, [20.0, 0.0, 30.0, 10.0])], "label string, score double, bbox array<double>")
    text = rows.select(features.feature_json(geometry.box_polygon(F.col("bbox")), F.struct("label", "score")).alias("feature"))
    features.write_collection(text, str(tmp_path / "f.geojson"), "EPSG:3857")
    found = one(statistics.detections(features.read_features(spark, str(tmp_path / "f.geojson"))))
    assert (found.target_count, found.mean_confidence, found.low_confidence_ratio, found.total_area_m2) == (2, 0.65, 0.5, 200)
    scene = scenes.synthetic(spark, 12, 7, 3)
    npz.write_scene(scene, str(tmp_path / "s.npz"), 12, 7, "uint8", crs="EPSG:3857", transform=(2, 0, 0, 0, -2, 0))
    info = npz.describe(str(tmp_path / "s.npz"))
    back = npz.read_scene(spark, str(tmp_path / "s.npz"))
    assert (info["width"], info["height"], info["count"], info["crs"]) == (12, 7, 3, "EPSG:3857")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, scene.collect()))


def test_an_oriented_box_needs_five_values(spark):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        spark.range(1).select(raster_ops.rotated_values(F.array(F.lit(1.0), F.lit(2.0)))).collect()


def test_burn_takes_all_boxes(spark, tmp_path):
    """x10 over ids beyond 500, against boxes drawn one after another."""
    sizes = {i: 1 + i * 13 % 50 for i in range(1, 1201)}
    spark.createDataFrame([(i, "b", s) for i, s in sizes.items()], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    drawn = {}
    for ordinal, (i, size) in enumerate(sizes.items(), 1):
        x, y = i * 37 % 400, i * 91 % 300
        a, b, c, d = (round(v / 3) for v in (x, y, x + size, y + size))
        drawn |= {(v, u): ordinal for v in range(max(b, 0), min(d, 100)) for u in range(max(a, 0), min(c, 134))}
    found = registry.queries()["x10_burn_instances"](spark, str(tmp_path)).collect()
    assert {(r.y, r.x): r.instance for r in found} == drawn and max(drawn.values()) > 1190 and len(found) == len(drawn)


@pytest.mark.parametrize("rows", [20, 90])
def test_the_whole_vector_scene_is_resampled(spark, tmp_path, rows):
    """g13 and g14 over a scene of any height: its first and last row are the target's."""
    table = [(i, [i / 4, 1.0, 2.0, 3.0], i) for i in range(25 * rows)]
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    wanted = {(y, x): round(y * ((rows - 1) / 44)) * 25 + round(x * (24 / 69)) for y in range(45) for x in range(70)}
    g13, g14 = (registry.queries()[q](spark, str(tmp_path)).collect() for q in ("g13_nearest_resample", "g14_align_to_reference"))
    assert {(r.y, r.x): r.class_id for r in g13} == wanted and wanted[44, 69] == 25 * rows - 1
    assert {(r.y, r.x): r["first"] * 4 for r in g14} == wanted and {r.bands for r in g14} == {3}


def test_conclusions_of_changes_and_indices(spark):
    """The wording that r14's SQL has no form of, as its numbers round on ties."""
    rows = [("change_detection", 0.0123456, 0.25, None, 3), ("change_detection", None, None, None, 0), ("spectral_indices", None, None, 0.43219, 1), ("spectral_indices", None, None, None, 0)]
    facts = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, task string, changed_area_km2 double, change_area_ratio double, mean double, flag_count int")
    facts = facts.selectExpr("*", "0.5D as mean_confidence", "0D as total_area_km2", "'a' as dominant_class")
    found = quality.with_facts(facts).select("i", quality.conclusion_summary(F.col("task")).alias("s")).orderBy("i").collect()
    assert [r.s for r in found] == [
        "本次变化检测变化面积约 0.012346 km2，占比 25.000%，质量标记 3 项。", "本次变化检测变化面积约 0.000000 km2，占比 0.000%，质量标记 0 项。",
        "本次光谱指数统计均值为 0.4322，需结合地物类型解释。", "本次光谱指数统计均值为 0.0000，需结合地物类型解释。",
    ]


def _overlap(a, b):
    shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / union if union > 0 else 0


@pytest.mark.parametrize("held", [500_000, 20])
def test_suppression_of_boxes_of_all_sizes(spark, monkeypatch, held):
    """Against going through the boxes by rank, with conflicts in one task and in rounds."""
    monkeypatch.setattr(nms, "EDGES", held)
    rng = np.random.default_rng(3)
    boxes = []
    for i in range(300):
        side, x, y = rng.choice([0.3, 1, 2, 5, 30, 300]), *rng.uniform(-50, 100, 2)
        boxes.append(("ab"[i % 2], i, float(rng.random()), [float(v) for v in (x, y, x + side * rng.uniform(0.5, 1), y + side * rng.uniform(0.5, 1))]))
    boxes += [("a", 900, 0.5, None), ("b", 901, 0.5, [3.0, 3.0, 3.0, 3.0])]
    found = nms.suppress(spark.createDataFrame(boxes, "raster_id string, id int, score double, bbox array<double>"), 0.1, [F.desc("score"), F.asc("id")]).collect()
    wanted = []
    for key in "ab":
        kept = []
        for _, i, _, box in sorted((b for b in boxes if b[0] == key), key=lambda b: (-b[2], b[1])):
            if box is None or all(_overlap(box, k) < 0.1 for k in kept):
                kept += [box] if box else []
                wanted.append(i)
    assert sorted(r.id for r in found) == sorted(wanted)


def test_ranks_and_percentiles_over_partitions(spark):
    rows = spark.createDataFrame([("ab"[i % 2] if i % 5 else None, float(i * 37 % 101), i) for i in range(400)], "k string, v double, id int").repartition(7)
    found = ranks.ranked(rows, ["k"], [F.desc("v"), F.asc("id")]).collect()
    for key in ("a", "b", None):
        own = sorted((r for r in found if r.k == key), key=lambda r: (-r.v, r.id))
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
    values = rows.withColumns({"w": F.when(F.col("id") < 1, 5.0), "none": F.lit(None).cast("double")})
    got = ranks.percentiles(values, ["v", "w", "none"], (0.05, 0.5, 0.95))
    assert np.allclose(got["v"], np.percentile([float(i * 37 % 101) for i in range(400)], [5, 50, 95])) and got["w"] == [5.0] * 3 and got["none"] == [None] * 3
    assert ranks.percentiles(values.limit(0), ["v"], (0.5,)) == {"v": [None]}


@pytest.mark.parametrize("held", [500_000, 100])
def test_components_of_many_tasks(spark, held):
    """Random edges, a long path and a hub, contracted in one task and in many."""
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 1000, (400, 2))] + [(i, i + 1) for i in range(2000, 2500)] + [(3000, 4000 + i) for i in range(600)]
    found = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", held).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    assert found == {x: top(x) for x in root}


@pytest.mark.parametrize(("source", "target"), [((1, 1), (1, 1)), ((1, 7), (5, 1)), ((7, 1), (1, 5)), ((5, 9), (13, 4)), ((13, 4), (5, 9)), ((10, 10), (10, 10)), ((3, 2), (97, 101)), ((97, 101), (3, 2))])
def test_resampling_joins_nothing(spark, source, target):
    pixels = spark.range(source[0] * source[1]).select((F.col("id") / source[1]).cast("long").alias("y"), (F.col("id") % source[1]).alias("x"), F.col("id").alias("v"))
    rows = raster_ops.resample(pixels.repartition(2), source, target)
    place = lambda i, n, m: 0 if n == 1 else int(np.rint(i * ((m - 1) / (n - 1))))
    wanted = {(y, x): place(y, target[0], source[0]) * source[1] + place(x, target[1], source[1]) for y in range(target[0]) for x in range(target[1])}
    found = rows.collect()
    assert len(found) == len(wanted) and {(r.y, r.x): r.v for r in found} == wanted
    plan = raster_ops.resample(pixels, source, target)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_burning_by_lines(spark):
    rng = np.random.default_rng(7)
    boxes = [(i + 1, [float(v) for v in (x, y, x + w, y + h)]) for i, (x, y, w, h) in enumerate(rng.uniform(-5, 40, (60, 4)))]
    boxes += [(99, [3.0, 3.0, 3.0, 9.0]), (70_000, [30.5, 30.5, 32.5, 31.5]), (100, None)]
    df = spark.createDataFrame(boxes, "ordinal long, bbox array<double>").repartition(3)
    image = np.zeros((35, 50), np.int64)
    for n, box in sorted(boxes, key=lambda b: b[0]):
        if box:
            x0, y0, x1, y1 = (int(np.clip(np.rint(v), 0, limit)) for v, limit in zip(box, (50, 35, 50, 35), strict=True))
            image[y0:y1, x0:x1] = min(n, 65535)
    assert {(r.y, r.x): r.instance for r in raster_ops.burn_instances(df, 50, 35).collect()} == {(y, x): image[y, x] for y, x in zip(*np.nonzero(image), strict=True)}
    runs = raster_ops.burn_runs(df, 50, 35).collect()
    lengths = sum(int((image[y, 1:] != image[y, :-1]).sum()) + 1 - int(image[y, 0] == 0) for y in range(35))
    assert sum(r.x1 - r.x0 for r in runs) == (image > 0).sum() and len(runs) <= lengths
    large = spark.createDataFrame([(1, [0.0, 0.0, 1e4, 1e4])], "ordinal long, bbox array<double>")
    assert raster_ops.burn_runs(large, 10_000, 10_000).count() == 10_000


def test_instances_beyond_16_bits(spark, tmp_path):
    """x10 over 66,000 boxes: the last ones keep their own numbers."""
    n = 66_000
    spark.range(n).selectExpr("id as p_partkey", "'b' as p_brand", "cast(9 + id % 2 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    image = np.zeros((100, 134), np.int64)
    for i in range(n):
        x, y, size = i * 37 % 400, i * 91 % 300, 9 + i % 2
        a, b, c, d = (round(v / 3) for v in (x, y, x + size, y + size))
        image[b:d, a:c] = i + 1
    drawn = {(y, x): image[y, x] for y, x in zip(*np.nonzero(image), strict=True)}
    found = registry.queries()["x10_burn_instances"](spark, str(tmp_path)).collect()
    assert {(r.y, r.x): r.instance for r in found} == drawn and len(found) == len(drawn) and image.max() == n
    runs = registry.queries()["x10_instance_runs"](spark, str(tmp_path)).collect()
    assert {(r.y, x): r.instance for r in runs for x in range(r.x0, r.x1)} == drawn and len({r.instance for r in runs}) > 100
