"""Statistics of indices, bands, classes, detections and changes: one aggregate each, and one more scan for percentiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import shoelace_area
from .components import components
from .ranks import order_statistics

SMALL_PATCH, LOW_SCORE = 9, 0.5


def summaries(df: DataFrame, values: list[str], *more: Column) -> tuple[list[dict], Row]:
    """Of each column its extent, mean, population deviation, 5th, 50th and 95th percentile and count, zeros of none; and further aggregates."""
    every = [f(v).alias(f"{i}_{n}") for i, v in enumerate(values) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop), ("valid_pixels", F.count))]
    parts, row = order_statistics(df, values, (0.05, 0.5, 0.95), *every, *more)
    out = []
    for i, v in enumerate(values):
        p = dict(zip(("p5", "p50", "p95"), parts[v], strict=True))
        own = {n: row[f"{i}_{n}"] for n in ("min", "max", "mean", "std")} | p
        out.append({n: float(x or 0.0) for n, x in own.items()} | {"valid_pixels": row[f"{i}_valid_pixels"]})
    return out, row


def _with_medians(df: DataFrame, aggregates: list[Column], medians: dict[str, str]) -> DataFrame:
    """One row of aggregates and of medians (name -> column), in two scans."""
    kinds = df.agg(*aggregates).schema.fields
    parts, row = order_statistics(df, list(medians.values()), (0.5,), *aggregates)
    found = [row[f.name] for f in kinds] + [parts[c][0] for c in medians.values()]
    return df.sparkSession.createDataFrame([found], T.StructType([*kinds, *(T.StructField(n, T.DoubleType()) for n in medians)]))


SUMMARY = "min double, max double, mean double, std double, p5 double, p50 double, p95 double, valid_pixels long"


def threshold_areas(df: DataFrame, value: str, rules: dict[str, Callable[[Column], Column]], area: float) -> DataFrame:
    """label, pixel_count, area_m2, area_km2: all rules in one pass."""
    counts = df.agg(*[F.count_if(test(F.col(value))).alias(f"c{i}") for i, test in enumerate(rules.values())])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"c{i}").alias("pixel_count")) for i, label in enumerate(rules)])).alias("r")).select("r.*")
    return rows.withColumns({"area_m2": F.col("pixel_count") * F.lit(float(area)), "area_km2": F.col("pixel_count") * F.lit(float(area)) / 1e6})


def band_statistics(pixels: DataFrame, bands: str = "bands") -> DataFrame:
    """By 1-based band: extent, mean, population deviation, valid and total pixels; zeros of none."""
    rows = pixels.select(F.posexplode(bands).alias("p", "v")).withColumn("v", F.when(F.isnan("v") | (F.abs("v") == float("inf")), None).otherwise(F.col("v")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy((F.col("p") + 1).alias("band")).agg(
        zero(F.min("v")).alias("min"), zero(F.max("v")).alias("max"), zero(F.avg("v")).alias("mean"), zero(F.stddev_pop("v")).alias("std"), F.count("v").alias("valid_pixels"), F.count("*").alias("total_pixels"),
    )


def feature_statistics(features: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """feature_count, mean and greatest score of those there are, distinct labels in order."""
    return features.agg(F.count("*").alias("feature_count"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"), F.array_join(F.sort_array(F.collect_set(F.coalesce(F.col(label), F.lit("")))), ",").alias("labels"))


def segmentation(mask: DataFrame, area: float, names: DataFrame | None = None) -> DataFrame:
    """By class, 0 too: pixels, areas, share, name, components, small patches and the largest one's area."""
    # the window is over classes, of which there are few
    counts = mask.groupBy("class_id").agg(F.count("*").alias("pixel_count")).withColumn("total", F.sum("pixel_count").over(Window.partitionBy()))
    patches = components(mask, ["class_id"]).groupBy("class_id").agg(F.count("*").alias("component_count"), F.count_if(F.col("pixel_count") < SMALL_PATCH).alias("small_patch_count"), F.max("pixel_count").alias("m"))
    rows = counts.join(patches, "class_id")
    rows = rows.join(names.select("class_id", "class_name"), "class_id", "left") if names is not None else rows.withColumn("class_name", F.lit(None).cast("string"))
    return rows.select(
        "class_id", F.coalesce("class_name", F.concat(F.lit("class_"), F.col("class_id").cast("string"))).alias("class_name"), "pixel_count", (F.col("pixel_count") * area).alias("area_m2"),
        (F.col("pixel_count") * area / 1e6).alias("area_km2"), (F.col("pixel_count") / F.col("total")).alias("ratio"), "component_count", "small_patch_count", (F.col("m") * area).alias("max_patch_area_m2"),
    )


def segmentation_totals(by_class: DataFrame) -> DataFrame:
    """One row over all classes; the dominant class is that of greatest share, the least id of ties."""
    return by_class.agg(
        F.sum("component_count").alias("connected_component_count"), F.sum("small_patch_count").alias("small_patch_count"), F.max("max_patch_area_m2").alias("max_patch_area_m2"),
        F.max_by("class_name", F.struct("ratio", -F.col("class_id"))).alias("dominant_class"), F.max("ratio").alias("dominant_ratio"), F.sum("area_km2").alias("total_area_km2"),
    )


def change(mask: DataFrame, area: float, run_names: bool = False) -> DataFrame:
    """One row of a change mask (y, x, changed): pixels, areas, share and patches; `run_names` as a run names them."""
    counts = mask.agg(F.count_if(F.col("changed") > 0).alias("changed_pixels"), F.count("*").alias("total_pixels"))
    patches = components(mask.filter(F.col("changed") > 0)).agg(F.count("*").alias("n"), F.count_if(F.col("pixel_count") < SMALL_PATCH).alias("s"), F.coalesce(F.max("pixel_count"), F.lit(0)).alias("m")).collect()[0]
    n, s, m = (F.lit(patches[c]).cast("long") for c in "nsm")
    names = ("changed_area_ratio", "change_patch_count", "largest_change_patch_m2") if run_names else ("change_area_ratio", "connected_component_count", "max_patch_area_m2")
    return counts.select(
        "changed_pixels", "total_pixels", (F.col("changed_pixels") * area).alias("changed_area_m2"), (F.col("changed_pixels") * area / 1e6).alias("changed_area_km2"),
        F.when(F.col("total_pixels") > 0, F.col("changed_pixels") / F.col("total_pixels")).otherwise(0.0).alias(names[0]), n.alias(names[1]), s.alias("small_patch_count"), (m * area).alias(names[2]),
    )


def record_statistics(records: DataFrame) -> DataFrame:
    """One row of a run's detections: label, score, touches_image_edge, angle_degrees (nullable)."""
    six = lambda c: F.bround(F.coalesce(c, F.lit(0.0)), 6)
    share = lambda c: six(F.when(F.count("*") > 0, c / F.count("*")))
    low, edge = F.count_if(F.col("score") < LOW_SCORE), F.count_if(F.col("touches_image_edge"))
    rows = _with_medians(records, [
        F.count("*").alias("count"), six(F.avg("score")).alias("confidence_mean"), low.alias("low_confidence_count"), share(low).alias("low_confidence_ratio"),
        edge.alias("edge_object_count"), share(edge).alias("edge_object_ratio"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"), F.coalesce(F.min("score"), F.lit(0.0)).alias("min_score"),
        *[F.bround(f("angle_degrees"), 6).alias(f"angle_degrees_{n}") for f, n in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"))],
    ], {"confidence_median": "score", "angle_degrees_median": "angle_degrees"})
    rows = rows.withColumn("confidence_median", six(F.col("confidence_median"))).withColumn("angle_degrees_median", F.bround("angle_degrees_median", 6))
    return rows.select(
        "count", "confidence_mean", "confidence_median", "low_confidence_count", "low_confidence_ratio", "edge_object_count", "edge_object_ratio", "max_score", "min_score",
        *[f"angle_degrees_{n}" for n in ("mean", "median", "min", "max")],
    )


def detections(features: DataFrame) -> DataFrame:
    """One row of stored detections (label, score, ring): density is by the features' own area."""
    rows = features.withColumn("area", shoelace_area(F.col("ring")))
    area = F.coalesce(F.sum("area"), F.lit(0.0))
    found = _with_medians(rows, [
        F.count("*").alias("target_count"), F.array_join(F.sort_array(F.collect_set(F.coalesce("label", F.lit("unknown")))), ",").alias("labels"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_confidence"),
        F.coalesce(F.avg((F.col("score") < LOW_SCORE).cast("double")), F.lit(0.0)).alias("low_confidence_ratio"), area.alias("total_area_m2"), F.when(area > 0, F.count("*") / area).otherwise(0.0).alias("density_per_m2"),
    ], {"median_confidence": "score"})
    found = found.withColumn("median_confidence", F.coalesce("median_confidence", F.lit(0.0)))
    return found.select("target_count", "labels", "mean_confidence", "median_confidence", "low_confidence_ratio", "total_area_m2", "density_per_m2")


def instances(features: DataFrame) -> DataFrame:
    return detections(features).withColumn("instance_count", F.col("target_count")).withColumn("small_patch_count", F.lit(0).cast("long"))


def index_statistics(df: DataFrame, value: str) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    found = _with_medians(df, [
        zero(F.min(value)).alias("min"), zero(F.max(value)).alias("max"), zero(F.avg(value)).alias("mean"), zero(F.stddev_pop(value)).alias("std"), F.count(value).alias("valid_pixels"), F.count("*").alias("total_pixels"),
    ], {"median": value})
    return found.select("min", "max", "mean", zero(F.col("median")).alias("median"), "std", "valid_pixels", "total_pixels")


def super_resolution(pair: DataFrame, scale: int, keys: list[str] | None = None) -> DataFrame:
    """pair: keys, source and result, structs of width, height, crs, transform. Whether each result is as the scale asks."""
    s, r = F.col("source"), F.col("result")
    want = {n: s["transform"][n] / (1.0 if n in "cf" else float(scale)) for n in "abcdef"}
    delta = F.greatest(*[F.abs(want[n] - r["transform"][n]) for n in "abcdef"])
    return pair.select(
        *(keys or []), (s["width"] * scale).alias("expected_width"), (s["height"] * scale).alias("expected_height"), ((s["width"] * scale == r["width"]) & (s["height"] * scale == r["height"])).alias("shape_matches_scale"),
        delta.alias("max_transform_delta"), (delta < 1e-9).alias("transform_matches_scale"), s["crs"].eqNullSafe(r["crs"]).alias("crs_matches"),
        ((want["a"] == r["transform"]["a"]) & (want["e"] == r["transform"]["e"])).alias("pixel_size_exact"),
    )
