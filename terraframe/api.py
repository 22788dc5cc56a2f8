"""The verbs of the engine on pixel tables: plans in, plans out, jobs recorded on the driver.

    engine = Engine(spark, "/work/jobs")
    engine.run_spectral_indices(scene, ["ndvi"], thresholds={"dense": 0.3}, transform=(2, 0, 0, 0, -2, 0))
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import affine, geometry, indices, tiles
from .operators import adapters, components, jobs, nms, quality, ranks, raster_ops, statistics
from .sources import catalog, exports, features, rasters


def _dict(df: DataFrame) -> dict:
    """One row of statistics as a dict."""
    found = df.limit(1).collect()
    return found[0].asDict(recursive=True) if found else {}


def validate(share: float) -> None:
    if not 0 <= share <= 1:
        raise ValueError("thresholds lie between 0 and 1")


class Engine:
    """Runs tasks on pixel tables (y, x, bands) as jobs; every run writes Parquet and a manifest to its job's folder."""

    def __init__(self, spark: SparkSession, folder: str, models: str | None = None):
        self.spark, self.jobs, self.models = spark, jobs.JobStore(folder), catalog.Models(models)

    # --- looking ---

    def inspect(self, path: str) -> dict:
        """Of a GeoTIFF or an NPZ container, whatever its name."""
        info = rasters.describe(catalog.validate_path(path))
        a, b, _, d, e, _ = info["transform"]
        return info | {"pixel_size": [abs(a), abs(e)], "area_per_pixel": abs(a * e - b * d), "is_georeferenced": info["crs"] is not None, "warning": None if info["crs"] else "no CRS"}

    def read(self, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
        """The pixels of a file: y, x, b1, b2 and so on; of some bands and a window (x, y, width, height) without reading the rest."""
        return rasters.read_scene(self.spark, catalog.validate_path(path), bands, window)

    def preflight(self, width: int, height: int, task: str, tile_size: int | None = None, overlap: int | None = None) -> dict:
        return _dict(tiles.preflight(self.spark, width, height, task, tile_size, overlap))

    def list_models(self) -> list[dict]:
        return self.models.list()

    # --- tasks ---

    def _submit(self, task: str, plan, model: dict | None = None, **parameters: Any) -> dict:
        """`plan(folder)` writes results and returns (outputs, statistics, flags)."""

        def work(folder: str) -> dict:
            outputs, found, flags = plan(folder)
            return jobs.build_manifest(task, folder, {}, outputs, parameters, found, flags, model)

        return self.jobs.submit(task, work, model_id=(model or {}).get("id"), parameters=parameters)

    @staticmethod
    def _save(df: DataFrame, folder: str, name: str) -> str:
        path = os.path.join(folder, name)
        df.write.mode("overwrite").parquet(path)
        return path

    def run_spectral_indices(self, pixels: DataFrame, names: list[str], band_map: Mapping[str, int] | None = None, thresholds=None, nodata: float | None = None, transform: tuple | None = None) -> dict:
        columns = [c for c in pixels.columns if c not in ("y", "x")]
        numbers = indices.resolve_bands(len(columns), band_map)
        indices.validate(names, numbers, len(columns))
        rules = indices.thresholds(thresholds)
        bands = {n: indices.without_nodata(F.col(columns[i - 1]), nodata) for n, i in numbers.items() if i <= len(columns)}
        t = tuple(transform or affine.DEFAULT_TRANSFORM)
        area = abs(t[0] * t[4] - t[1] * t[3])

        def plan(folder: str):
            rows = pixels.select("y", "x", *[indices.index(n, bands).alias(n) for n in names])
            path = self._save(rows, folder, "indices.parquet")
            stored = self.spark.read.parquet(path)
            each, row = statistics.summaries(stored, names, *[F.count_if(test(F.col(n))).alias(f"{n}_{label}_pixels") for n in names for label, test in rules.items()])
            found = {f"{n}_{k}": v for n, own in zip(names, each, strict=True) for k, v in own.items()} | {f"{n}_{label}_pixels": row[f"{n}_{label}_pixels"] for n in names for label in rules}
            flags = []
            for n in names:
                found[f"{n}_areas"] = {label: {"pixel_count": (p := found.pop(f"{n}_{label}_pixels")), "area_m2": p * area, "area_km2": p * area / 1e6} for label in rules}
                limit = indices.EXPECTED.get(n, indices.USUAL_RANGE)
                if not found[f"{n}_valid_pixels"]:
                    flags.append({"code": "empty_index", "severity": "warning", "message": f"{n.upper()} has no finite valid pixels."})
                elif found[f"{n}_min"] < -limit or found[f"{n}_max"] > limit:
                    flags.append({"code": "index_value_out_of_range", "severity": "warning", "message": f"{n.upper()} values are outside the expected range: min={found[f'{n}_min']:.3f}, max={found[f'{n}_max']:.3f}."})
            return {"indices": path}, found, flags

        return self._submit("spectral_indices", plan, indices=names, thresholds=thresholds)

    def _model(self, task: str, model_id: str | None, **options) -> tuple[dict, adapters.Make | None]:
        """The description of a task's model, and what makes its adapter, if it isn't a plan."""
        model = self.models.check(self.models.resolve(task, model_id))
        return model, adapters.maker(model, **options)

    def run_semantic_segmentation(self, pixels: DataFrame, bands: list[str], names: DataFrame | str | None = None, area: float = 1.0, model_id: str | None = None, size: tuple[int, int] | None = None, make=None, tile: int = 512, overlap: int = 64) -> dict:
        """`make`, or a model with an adapter, needs the size (width, height). `names`: class_id and class_name, or the path of a class map."""
        model, made = self._model("semantic_segmentation", model_id)
        names = catalog.class_map(self.spark, catalog.validate_path(names)) if isinstance(names, str) else names
        make = make or made
        tiles.validate(tile, overlap)

        def plan(folder: str):
            if make is not None:
                rows = adapters.segment(pixels, bands, size, make, tile, overlap)
            else:
                rows = pixels.select("y", "x", raster_ops.segment(F.array(*[F.col(b).cast("double") for b in bands])).alias("class_id"))
                rows = rows.withColumn("probs", raster_ops.segment_probabilities(F.col("class_id")))
            path = self._save(rows.select("y", "x", "class_id", F.col("probs").cast("array<float>").alias("probs")), folder, "mask.parquet")
            by_class = statistics.segmentation(self.spark.read.parquet(path), area, names)
            classes = self._save(by_class, folder, "classes.parquet")
            return {"mask": path, "classes": classes}, self._segmentation(self.spark.read.parquet(classes)), []

        return self._submit("semantic_segmentation", plan, model, bands=bands, area_per_pixel=area)

    @staticmethod
    def _segmentation(by_class: DataFrame) -> dict:
        ratios = {r["class_name"]: r["ratio"] for r in by_class.select("class_name", "ratio").orderBy("class_id").collect()}
        return _dict(statistics.segmentation_totals(by_class)) | {"class_ratios": ratios}

    def run_change_detection(self, before: DataFrame, after: DataFrame, bands: list[str], threshold: float = 0.2, area: float = 1.0, model_id: str | None = None, sizes: tuple | None = None, auto_align: bool = False, make=None, tile: int = 512, overlap: int = 64) -> dict:
        """sizes: ((height, width) before, (height, width) after), where they may differ; needed by a model with an adapter."""
        validate(share=threshold)
        tiles.validate(tile, overlap)
        model, made = self._model("change_detection", model_id)
        make = make or made
        flags = []
        if sizes and sizes[0] != sizes[1]:
            if not auto_align:
                raise ValueError("alignment: shape_mismatch")
            after = raster_ops.resample(after, sizes[1], sizes[0])
            flags = [{"code": c, "severity": "warning", "message": c} for c in ("alignment_shape_mismatch", "simple_resampling_only_no_feature_registration")]

        def plan(folder: str):
            if make is not None:
                rows = adapters.change(before, after, bands, sizes[0][::-1], make, tile, overlap)
            else:
                later = after.select("y", "x", F.array(*[F.col(b).cast("double") for b in bands]).alias("__after"))
                prob = raster_ops.change_probability(F.array(*[F.col(b).cast("double") for b in bands]), F.col("__after"))
                rows = before.join(later, ["y", "x"]).select("y", "x", prob.alias("probability"))
            path = self._save(rows.withColumn("changed", (F.col("probability") >= threshold).cast("int")), folder, "change.parquet")
            mask = self.spark.read.parquet(path)
            patches = components.numbered(components.components(mask.filter("changed > 0").select("y", "x")), out="change_id")
            return {"mask": path, "patches": self._save(patches, folder, "patches.parquet")}, _dict(statistics.change(mask, area)), flags

        return self._submit("change_detection", plan, model, threshold=threshold, area_per_pixel=area)

    def run_detection(self, pixels: DataFrame, bands: list[str], size: tuple[int, int], make=None, task: str = "object_detection", tile: int = 512, overlap: int = 64, score: float = 0.0, iou: float = 0.5, model_id: str | None = None, transform: tuple | None = None, crs: str | None = None) -> dict:
        """Records with boxes, polygons in the scene's coordinates and, for instances, a mask of their numbers.

        `make`, or a model with an adapter, is run by tile; else the deterministic model runs as a plan. Oriented
        boxes are neither clipped nor suppressed. Records are numbered before suppression.
        """
        validate(share=iou)
        if score < 0:
            raise ValueError("the score threshold must not be negative")
        tiles.validate(tile, overlap)
        model, made = self._model(task, model_id, confidence_threshold=score, iou_threshold=iou)
        make = make or made
        width, height = size
        oriented = task == "oriented_detection"
        name = {"object_detection": "detections", "oriented_detection": "oriented_detections", "instance_segmentation": "instances"}[task]

        def found_boxes() -> DataFrame:
            if make is not None:
                return adapters.detect(pixels, bands, size, make, tile, overlap, score, clip=not oriented)
            gray = tiles.assign(pixels, width, height, tile, overlap).select(
                "tile_seq", (F.col("y") - F.col("tile_y0")).alias("ty"), (F.col("x") - F.col("tile_x0")).alias("tx"), F.lit(min(tile, height)).alias("th"), F.lit(min(tile, width)).alias("tw"),
                (sum((F.col(b) for b in bands[1:]), F.col(bands[0])) / len(bands)).alias("gray"),
            )
            places = tiles.grid(self.spark, width, height, tile, overlap).select("tile_seq", "x0", "y0")
            found = raster_ops.detect_bright(gray, width, height, task == "instance_segmentation").join(places, "tile_seq")
            shifted = geometry.translate_box(F.col("bbox"), F.col("x0"), F.col("y0"))
            shifted = shifted if oriented else geometry.clip_box(shifted, F.lit(width), F.lit(height))
            found = found.select("tile_seq", "idx", "label", F.lit(0).alias("class_id"), "score", shifted.alias("bbox")).filter(F.col("score") >= score)
            if oriented:
                turned = raster_ops.oriented(found)
                return turned.withColumn("rotated", F.array("cx", "cy", "width", "height", "angle")).drop("cx", "cy", "width", "height", "angle")
            return found.filter(~geometry.is_empty(F.col("bbox"))).withColumns({"rotated": F.lit(None).cast("array<double>"), "polygon": F.lit(None).cast("array<struct<x:double,y:double>>")})

        def plan(folder: str):
            found, turned = found_boxes().withColumn("raster_id", F.lit("scene")), F.col("rotated")
            if oriented:
                corners = F.when(turned.isNotNull(), geometry.rotated_box_polygon(*[turned[i] for i in range(5)])).otherwise(geometry.box_polygon(F.col("bbox")))
                found = found.withColumn("polygon", F.coalesce("polygon", corners)).withColumn("bbox", geometry.polygon_bounds(F.col("polygon")))
            else:
                found = found.withColumn("polygon", F.coalesce("polygon", geometry.box_polygon(F.col("bbox"))))
            found = found.withColumns({"touches_image_edge": geometry.touches_edge(F.col("bbox"), F.lit(width), F.lit(height)), "area_pixels": geometry.box_area(F.col("bbox")), "angle_degrees": turned[4]})
            found = ranks.ranked(found, ["raster_id"], [F.col("tile_seq"), F.col("idx")], "instance_id")
            if not oriented and iou > 0:
                found = nms.suppress(found, iou, [F.desc("score"), F.asc("instance_id")])
            else:
                found = found.withColumn("rank", F.col("instance_id"))
            found = found.withColumn("ring", geometry.to_geo(F.col("polygon"), affine.transform(transform)))
            outputs = {"detections": (path := self._save(found, folder, f"{name}.parquet"))}
            stored = self.spark.read.parquet(path)
            shown = F.struct("instance_id", "label", "class_id", "score", "tile_seq", F.col("bbox").alias("bbox_pixel"), "area_pixels", "touches_image_edge", F.col("rotated").alias("rotated_box"))
            lines = stored.orderBy("rank").select(features.feature_json(F.col("ring"), shown).alias("feature"))
            outputs["geojson"] = os.path.join(folder, f"{name}.geojson")
            features.write_collection(lines, outputs["geojson"], crs)
            outputs["gpkg"] = os.path.join(folder, f"{name}.gpkg")
            exports.write_gpkg(stored.orderBy("rank").select("instance_id", "label", "class_id", "score", "tile_seq", "bbox", "ring"), outputs["gpkg"], name)
            if task == "instance_segmentation":
                numbered = ranks.ranked(stored.select("raster_id", "rank", "bbox"), ["raster_id"], [F.col("rank")], "ordinal")
                outputs["instance_mask"] = self._save(raster_ops.burn_instances(numbered, width, height), folder, "instance_mask.parquet")
            row = _dict(statistics.record_statistics(stored))
            flags = [] if row["count"] else [{"code": "empty_result", "severity": "warning", "message": "No detections survived thresholding."}]
            return outputs, row, flags

        return self._submit(task, plan, model, tile_size=tile, overlap=overlap, score_threshold=score, nms_threshold=iou)

    def run_super_resolution(self, pixels: DataFrame, scale: int = 2, transform: tuple | None = None, model_id: str | None = None, size: tuple[int, int] | None = None, make=None, tile: int = 256, overlap: int = 32, reference: DataFrame | None = None) -> dict:
        """`make`, or a model with an adapter, needs the size (width, height). A reference image is brought to the result's grid and compared with it, band by band."""
        if scale <= 0:
            raise ValueError("scale must be positive")
        tiles.validate(tile, overlap)
        model, made = self._model("super_resolution", model_id)
        make = make or made
        bands = [c for c in pixels.columns if c not in ("y", "x")]
        rows = adapters.upscale(pixels, bands, size, scale, make, tile, overlap) if make is not None else raster_ops.upscale(pixels, scale)
        a, b, c, d, e, f = tuple(transform or affine.DEFAULT_TRANSFORM)[:6]
        finer = (a / scale, b / scale, c, d / scale, e / scale, f)

        def plan(folder: str):
            outputs = {"image": self._save(rows, folder, "image.parquet")}
            found = {"type": "super_resolution", "scale": scale, "transform": finer, "transform_matches_scale": True, "reference_metrics_available": reference is not None}
            if reference is None:
                return outputs, found, [{"code": "no_reference_image", "severity": "info", "message": "No reference image provided; PSNR/SSIM were not calculated."}]
            outputs["reference"] = self._save(reference, folder, "reference.parquet")
            more, flags = self._compare(self.spark.read.parquet(outputs["image"]), self.spark.read.parquet(outputs["reference"]))
            return outputs, found | more, flags

        return self._submit("super_resolution", plan, model, scale=scale, transform=list(transform or affine.DEFAULT_TRANSFORM), size=size)

    @staticmethod
    def _compare(image: DataFrame, reference: DataFrame) -> tuple[dict, list[dict]]:
        """PSNR and SSIM of an image and a reference of as many bands, which nearest resampling brings to the image's size."""
        size = lambda df: tuple(df.agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).collect()[0])
        bands, others = ([c for c in df.columns if c not in ("y", "x")] for df in (image, reference))
        target, source = size(image), size(reference)
        if None in target + source:
            return {"psnr": None, "ssim": None, "reference_shape": None}, [{"code": "optional_metric_skipped", "severity": "info", "message": "The image or its reference has no pixels."}]
        flags = [] if len(bands) == len(others) else [{"code": "optional_metric_skipped", "severity": "info", "message": f"{len(bands)} band(s) of the image and {len(others)} of the reference: the first {min(len(bands), len(others))} compared."}]
        other = (raster_ops.resample(reference, source, target) if source != target else reference).select("y", "x", *[F.col(c).cast("double").alias(f"__r{i}") for i, c in enumerate(others)])
        n = min(len(bands), len(others))
        pairs = image.join(other, ["y", "x"]).select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("band"), F.col(f"__r{i}").alias("a"), F.col(bands[i]).cast("double").alias("b")) for i in range(n)])).alias("p")).select("p.*")
        psnr, ssim = raster_ops.psnr(pairs, "a", "b").collect()[0]["psnr"], raster_ops.ssim(pairs, "band", "a", "b").collect()[0]["ssim"]
        flags.append({"code": "optional_metric_skipped", "severity": "info", "message": "lpips_unavailable"})
        return {"psnr": psnr, "ssim": ssim, "reference_shape": list(source)}, flags

    # --- afterwards ---

    def statistics_of(self, record: dict) -> dict:
        """A job's statistics anew from what it stored, by task."""
        task, outputs, parameters = record["task"], record["outputs"], record["parameters"]
        read = lambda name: self.spark.read.parquet(outputs[name])
        area = float(parameters.get("area_per_pixel") or 1.0)
        if task == "semantic_segmentation":
            return {"type": task} | self._segmentation(read("classes"))
        if task in ("object_detection", "oriented_detection"):
            return {"type": task} | _dict(statistics.detections(read("detections")))
        if task == "instance_segmentation":
            return {"type": task} | _dict(statistics.instances(read("detections")))
        if task == "change_detection":
            return {"type": task} | _dict(statistics.change(read("mask"), area))
        if task == "super_resolution":
            scale, size, stored = int(parameters["scale"]), parameters.get("size"), record["statistics"]
            extent = read("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).collect()[0]
            wanted = [size[0] * scale, size[1] * scale] if size else [extent["w"], extent["h"]]
            want = [v if n in "cf" else v / scale for n, v in zip("abcdef", parameters["transform"], strict=False)]
            delta = max(abs(x - y) for x, y in zip(want, stored["transform"], strict=True))
            return {"type": task, "scale": scale, "expected_width": wanted[0], "expected_height": wanted[1], "shape_matches_scale": wanted == [extent["w"], extent["h"]], "max_transform_delta": delta, "transform_matches_scale": delta < 1e-9, "transform": stored["transform"]}
        if task == "spectral_indices":
            rows = read("indices")
            return {"type": task, "indices": {n: _dict(statistics.index_statistics(rows, n)) for n in rows.columns if n not in ("y", "x")}}
        if task == "statistics":
            return record["statistics"]
        raise ValueError(f"no analysis for task {task!r}")

    def calculate_statistics(self, path: str | None = None, job_id: str | None = None, zones: str | None = None) -> dict:
        """Statistics of a file, or of what a job gave: its GeoJSON, else its mask, image, or the first output that can be read."""
        record = self.jobs.get(job_id) if job_id else None
        outputs = record["outputs"] if record else {}
        known = (".tif", ".tiff", ".geojson", ".npz")
        target = outputs.get("geojson") or outputs.get("mask") or outputs.get("image") or next((v for v in outputs.values() if v.lower().endswith(known)), None) or next(iter(outputs.values()), None) or path
        if target is None:
            raise ValueError("a file or a job is needed")

        def plan(folder: str):
            if target.lower().endswith((".geojson", ".json")):
                found = _dict(statistics.feature_statistics(features.read_features(self.spark, target)))
                flags = [] if found["feature_count"] else [{"code": "empty_vector", "severity": "warning", "message": "Vector result contains no features."}]
            else:
                rows = self.spark.read.parquet(target) if os.path.isdir(target) else self.read(target)
                bands = [c for c, kind in rows.dtypes if c not in ("y", "x") and not kind.startswith(("array", "struct", "string"))]
                by_band = statistics.band_statistics(rows.select(F.array(*[F.col(b).cast("double") for b in bands]).alias("bands"))).orderBy("band")
                found, flags = {"bands": [r.asDict() for r in by_band.collect()]}, []
            if zones:
                flags.append({"code": "zonal_stats_not_run", "severity": "info", "message": "Zonal statistics are not part of this task.", "zones_path": zones})
            out = os.path.join(folder, "stats.json")
            with open(out, "w", encoding="utf-8") as file:
                json.dump(found, file, indent=2, ensure_ascii=False, default=jobs.plain)
            return {"stats_json": out}, found, flags

        return self._submit("statistics", plan, {"id": "statistics", "backend": "spark"}, source=target, zones=zones)

    def check_quality(self, path: str | None = None, job_id: str | None = None) -> dict:
        """Flags of a file, or of a job's results and their files, as a job of its own: what is missing, cannot be read, is empty or has no CRS."""
        record = self.jobs.get(job_id) if job_id else None
        if record is None and path is None:
            raise ValueError("a file or a job is needed")
        outputs = record["outputs"] if record else {"input_path": path}

        def plan(folder: str):
            flags = list(record["quality_flags"]) if record else []
            if record and record["statistics"].get("count") == 0:
                flags.append({"code": "empty_result", "severity": "warning", "message": "Source manifest reports zero records."})
            missing = [n for n, v in outputs.items() if v and not os.path.exists(v)]
            if missing:
                flags.append({"code": "missing_outputs", "severity": "error", "message": f"Missing output files: {', '.join(missing)}."})
            target = path or next((v for v in outputs.values() if v and v.lower().endswith((".tif", ".tiff"))), None)
            if target:
                try:
                    info = rasters.describe(target)
                except (OSError, ValueError, KeyError) as error:
                    flags.append({"code": "raster_read_failed", "severity": "error", "message": f"Could not read raster: {error}"})
                else:
                    if not info["crs"]:
                        flags.append({"code": "crs_missing", "severity": "warning", "message": "Raster CRS is missing."})
                    if info["fallback_container"]:
                        flags.append({"code": "fallback_raster_io", "severity": "info", "message": "Rasterio unavailable; fallback raster container was used."})
            flags = list({(f["code"], f["message"]): f for f in reversed(flags)}.values())[::-1]
            out = os.path.join(folder, "quality.json")
            with open(out, "w", encoding="utf-8") as file:
                json.dump({"quality_flags": flags, "checked_outputs": outputs}, file, indent=2, ensure_ascii=False, default=jobs.plain)
            return {"quality_json": out}, {"flag_count": len(flags), "error_count": sum(f["severity"] == "error" for f in flags)}, flags

        return self._submit("quality_check", plan, {"id": "quality-checker", "backend": "rules"}, source=path or job_id)

    def analyze(self, job_id: str) -> dict:
        """Statistics anew, the rules' flags and a conclusion, stored beside the job's results and in its record."""
        record = self.jobs.get(job_id)
        found = self.statistics_of(record)
        known = {k: v for k, v in (found | record["parameters"]).items() if k in quality.FACTS and v is not None}
        fields = ", ".join(["job_id string", "task string", *(f"`{k}` {quality.FACTS[k]}" for k in known)])
        cast = {"bigint": int, "int": int, "double": float, "string": str, "boolean": bool}
        row = quality.with_facts(self.spark.createDataFrame([(job_id, record["task"], *(cast[quality.FACTS[k]](v) for k, v in known.items()))], fields))
        flags = quality.run_checks(row).orderBy("seq").collect()
        flags = record["quality_flags"] + [{"code": f["code"], "severity": f["severity"], "message": f["message"]} for f in flags]
        flags = list({(f["code"], f["message"]): f for f in reversed(flags)}.values())[::-1]
        held = self.spark.createDataFrame([([(f["code"], f["severity"], f["message"]) for f in flags],)], "flags array<struct<code:string,severity:string,message:string>>")
        parts = quality.conclusion(F.col("task"), F.col("flags"))
        said = _dict(row.crossJoin(F.broadcast(held)).withColumn("flag_count", F.size("flags")).select(*[c.alias(n) for n, c in parts.items()]))
        for name, body in (("stats", found), ("quality", {"quality_flags": flags})):
            record["outputs"][f"{name}_json"] = os.path.join(record["output_dir"], f"{name}.json")
            with open(record["outputs"][f"{name}_json"], "w", encoding="utf-8") as file:
                json.dump(body, file, indent=2, ensure_ascii=False, default=jobs.plain)
        with open(record["manifest_path"], encoding="utf-8") as file:
            manifest = json.load(file)
        jobs.write_manifest(manifest | {"statistics": found, "stats": found, "quality_flags": flags, "conclusion": said, "outputs": record["outputs"]})
        return self.jobs.update(job_id, statistics=found, quality_flags=flags, conclusion=said, outputs=record["outputs"])

    def report(self, job_id: str) -> str:
        """Markdown of a job's record; it is analysed first if it wasn't."""
        record = self.jobs.get(job_id)
        record = record if "conclusion" in record else self.analyze(job_id)
        bullets = lambda items: "\n".join(f"- {i}" for i in items) or quality.EMPTY["list"]
        lines = lambda d: "\n".join(f"- {k}: `{v}`" for k, v in d.items())
        parts = {
            "数据概况": f"- Job ID: `{job_id}`\n- Task: `{record['task']}`\n- Status: `{record['status']}`", "使用模型": f"- Model ID: `{record['model_id']}`", "参数设置": f"`{record['parameters']}`",
            "推理结果": lines(record["outputs"]) or quality.EMPTY["outputs"], "统计分析": lines(record["statistics"]) or quality.EMPTY["statistics"],
            "质量检查": "\n".join(f"- [{f['severity']}] {f['code']}: {f['message']}" for f in record["quality_flags"]) or quality.EMPTY["flags"], "结论": f"{record['conclusion']['summary']}\n- Confidence: `{record['conclusion']['confidence']}`\n" + bullets(record["conclusion"]["key_findings"]),
            "风险与局限": bullets(record["conclusion"]["limitations"]), "建议人工复核区域": bullets(record["conclusion"]["recommended_review_areas"]), "下一步建议": bullets(record["conclusion"]["next_steps"]),
            "输出文件清单": lines(record["outputs"]) or quality.EMPTY["outputs"],
        }
        text = "\n".join(["# 遥感处理分析报告", "", *(f"## {n}\n{parts.get(n, quality.EMPTY['list'])}\n" for n in quality.SECTIONS)])
        path = os.path.join(record["output_dir"], "analysis_report.md")
        with open(path, "w", encoding="utf-8") as file:
            file.write(text)
        return path
