"""Operators on pixel tables: models of reference, change, resampling, quality of images, extents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_polygon, rotated_box_polygon
from .components import components
from .graph import cut

#: Fixed values of the deterministic models.
BRIGHT_FLOOR, LEAST_PIXELS, MOST_DETECTIONS, ANGLE = 150.0, 12, 8, 25.0
BRIGHT_CLASS, BLUE_CLASS = 185.0, 120.0
CHANGE_SPAN = 128.0
#: Greatest instance of a mask of 16 bits.
MOST_INSTANCES = 65535


# --- segmentation -----------------------------------------------------------------------------

def segment(bands: Column) -> Column:
    """Class by pixel from bands red, green, blue and more: 2 where blue leads and is strong, else 1 where bright, else 0."""
    red, green, blue = (F.element_at(bands, F.least(F.lit(i), F.size(bands))) for i in (1, 2, 3))
    bright = F.aggregate(bands, F.lit(0.0), lambda s, v: s + v) / F.size(bands) > BRIGHT_CLASS
    leads = (blue > green) & (blue > red) & (blue > BLUE_CLASS)
    return F.when(leads, 2).when(bright, 1).otherwise(0)


def segment_probabilities(mask: Column, classes: int = 3) -> Column:
    raw = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == mask, 0.9).otherwise(0.05).cast("double"))
    total = F.aggregate(raw, F.lit(0.0), lambda s, v: s + v)
    return F.transform(raw, lambda v: v / F.greatest(total, F.lit(1e-6)))


def class_extents(mask: DataFrame, names: DataFrame | None = None, by: str = "class_id") -> DataFrame:
    """Box, pixels and name of every class but 0; the name of an unlisted one is class_<id>."""
    rows = mask.filter(F.col(by) != 0).groupBy(by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.count("*").alias("pixel_count"))
    if names is not None:
        rows = rows.join(names.select(by, "class_name"), by, "left")
    else:
        rows = rows.withColumn("class_name", F.lit(None).cast("string"))
    return rows.withColumn("class_name", F.coalesce("class_name", F.concat(F.lit("class_"), F.col(by).cast("string"))))


# --- change -----------------------------------------------------------------------------------

def change_probability(before: Column, after: Column) -> Column:
    """Mean over bands of the absolute difference, over 128, within 0 and 1; bands are arrays."""
    gaps = F.zip_with(before, after, lambda a, b: F.abs(b - a))
    mean = F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / F.size(gaps)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean / CHANGE_SPAN))


def alignment(a: Column, b: Column) -> Column:
    """Issues of a pair of scenes (structs of crs, width, height, transform, bounds), in order."""
    t, u = a["transform"], b["transform"]
    near = lambda x, y: F.round(x, 9) == F.round(y, 9)
    any_of = lambda tests: F.array_contains(F.array(*[F.coalesce(~x, F.lit(True)) for x in tests]), True)
    issues = [
        (~a["crs"].eqNullSafe(b["crs"]), "crs_mismatch"),
        ((a["width"] != b["width"]) | (a["height"] != b["height"]), "shape_mismatch"),
        (any_of([t[n] == u[n] for n in "abcdef"]), "transform_mismatch"),
        (any_of([near(a["bounds"][n], b["bounds"][n]) for n in ("xmin", "ymin", "xmax", "ymax")]), "bounds_mismatch"),
        (any_of([near(F.abs(t[n]), F.abs(u[n])) for n in "ae"]), "resolution_mismatch"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in issues]))


def alignment_warnings(issues: Column) -> Column:
    named = F.transform(issues, lambda i: F.concat(F.lit("alignment_"), i))
    return F.when(F.size(issues) > 0, F.concat(named, F.array(F.lit("simple_resampling_only_no_feature_registration")))).otherwise(named)


# --- resampling -------------------------------------------------------------------------------

def nearest(i: Column, target: int, source: int) -> Column:
    """Source index of a target index: evenly spaced positions, half-even rounded."""
    if target == 1:
        return F.lit(0)
    return F.rint(i * F.lit((source - 1) / (target - 1))).cast("long")


def filled(i: Column, target: int, source: int) -> Column:
    """The target indices that a source index fills, by the inverse of `nearest`: none, one or a run of them."""
    if target == 1:
        return F.when(i == 0, F.array(F.lit(0).cast("long")))
    if source == 1:
        return F.when(i == 0, F.sequence(F.lit(0).cast("long"), F.lit(target - 1).cast("long")))
    step = (source - 1) / (target - 1)
    first = F.greatest(F.lit(0), F.floor((i - 0.5) / step) - 1).cast("long")
    last = F.least(F.lit(target - 1), F.ceil((i + 0.5) / step) + 1).cast("long")
    return F.when(first <= last, F.filter(F.sequence(first, last), lambda t: nearest(t, target, source) == i))


def resample(pixels: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Pixels (y, x, ...) on another grid of (height, width): each goes to the places that it fills, so nothing is joined or shuffled."""
    more = [c for c in pixels.columns if c not in ("y", "x")]
    rows = pixels.withColumn("y", F.explode(filled(F.col("y"), target[0], source[0])))
    return rows.withColumn("x", F.explode(filled(F.col("x"), target[1], source[1]))).select("y", "x", *more)


def upscale(pixels: DataFrame, scale: int) -> DataFrame:
    """Each pixel as scale x scale of them."""
    if scale not in (2, 4):
        raise ValueError("scale must be 2 or 4")
    steps = F.sequence(F.lit(0), F.lit(scale - 1))
    rows = pixels.withColumn("__dy", F.explode(steps)).withColumn("__dx", F.explode(steps))
    return rows.withColumns({"y": F.col("y") * scale + F.col("__dy"), "x": F.col("x") * scale + F.col("__dx")}).drop("__dy", "__dx")


def psnr(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row psnr: of two columns of paired samples; infinite where they are equal."""
    rows = pairs.agg(F.avg(F.pow(F.col(a) - F.col(b), 2)).alias("mse"), F.max(F.greatest(a, b)).alias("top"))
    span = F.when(F.col("top") > 1.5, 255.0).otherwise(1.0)
    return rows.select(F.when(F.col("mse") <= 0, F.lit(float("inf"))).otherwise(20 * F.log10(span) - 10 * F.log10("mse")).alias("psnr"))


def ssim(pairs: DataFrame, band: str, a: str, b: str) -> DataFrame:
    """One row ssim: global by band, averaged over bands."""
    top = pairs.agg(F.max(F.greatest(a, b)).alias("top")).collect()[0]["top"]
    span = F.lit(255.0 if top is not None and top > 1.5 else 1.0)
    rows = pairs.groupBy(band).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("cov"))
    c1, c2 = F.pow(0.01 * span, 2), F.pow(0.03 * span, 2)
    value = ((2 * F.col("ma") * F.col("mb") + c1) * (2 * F.col("cov") + c2)) / ((F.col("ma") * F.col("ma") + F.col("mb") * F.col("mb") + c1) * (F.col("va") + F.col("vb") + c2))
    return rows.select(value.alias("v")).agg(F.avg("v").alias("ssim"))


# --- detection --------------------------------------------------------------------------------

def detect_bright(tiles: DataFrame, width: int, height: int, instance: bool = False, key: str = "tile_seq", digits: int = 4) -> DataFrame:
    """Bright objects by tile: key, idx (1-based, in scan order), bbox (tile-local), score.

    `tiles`: key, ty, tx (place in the tile), th, tw (its size), gray. The threshold is the mean plus a
    standard deviation, at least BRIGHT_FLOOR; components of at least LEAST_PIXELS count, the first
    MOST_DETECTIONS of a tile. Without any, and not for instances, a box about the brightest pixel stands.
    """
    stats = tiles.groupBy(key).agg(F.avg("gray").alias("m"), F.stddev_pop("gray").alias("s"), F.max(F.struct("gray", (-F.col("ty")).alias("ny"), (-F.col("tx")).alias("nx"), "th", "tw")).alias("top"))
    stats = cut(stats.withColumn("limit", F.greatest(F.lit(BRIGHT_FLOOR), F.col("m") + F.col("s"))))
    lit = tiles.join(stats.select(key, "limit"), key)
    test = F.col("gray") > F.col("limit") if instance else F.col("gray") >= F.col("limit")
    found = components(lit.filter(test).select(key, F.col("ty").alias("y"), F.col("tx").alias("x")), [key]).filter(F.col("pixel_count") >= LEAST_PIXELS)
    found = found.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy("first_y", "first_x"))).filter(F.col("idx") <= MOST_DETECTIONS)
    boxes = cut(found.select(key, "idx", "x0", "y0", "x1", "y1"))
    if not instance:
        half = F.greatest(F.lit(4), F.floor(F.least("top.th", "top.tw") / 12))
        cy, cx = -F.col("top.ny"), -F.col("top.nx")
        spare = stats.join(boxes.select(key).distinct(), key, "left_anti").select(
            key, F.lit(1).alias("idx"), F.greatest(F.lit(0), cx - half).alias("x0"), F.greatest(F.lit(0), cy - half).alias("y0"),
            F.least(F.col("top.tw"), cx + half).alias("x1"), F.least(F.col("top.th"), cy + half).alias("y1"),
        )
        boxes = boxes.unionByName(spare)
    inside = (F.col("tx") >= F.col("x0")) & (F.col("tx") < F.col("x1")) & (F.col("ty") >= F.col("y0")) & (F.col("ty") < F.col("y1"))
    means = boxes.join(tiles.select(key, "ty", "tx", "gray"), key).filter(inside).groupBy(key, "idx", "x0", "y0", "x1", "y1").agg(F.avg("gray").alias("g"))
    score = F.bround(F.greatest(F.lit(0.05), F.least(F.lit(0.99), F.col("g") / 255)), digits)
    label = "bright_instance" if instance else "bright_object"
    return means.select(key, "idx", F.lit(label).alias("label"), score.alias("score"), F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]).alias("bbox"))


def oriented(detections: DataFrame) -> DataFrame:
    """Adds cx, cy, width, height, angle and the polygon of each box, turned by ANGLE about its centre."""
    b = F.col("bbox")
    rows = detections.withColumns({"cx": (b[0] + b[2]) / 2, "cy": (b[1] + b[3]) / 2, "width": F.greatest(F.lit(1.0), b[2] - b[0]), "height": F.greatest(F.lit(1.0), b[3] - b[1]), "angle": F.lit(ANGLE)})
    rows = rows.withColumn("polygon", rotated_box_polygon(F.col("cx"), F.col("cy"), F.col("width"), F.col("height"), F.col("angle")))
    return rows.withColumn("label", F.concat(F.lit("oriented_"), F.col("label")))


def burn_runs(boxes: DataFrame, width: int, height: int, most: int | None = MOST_INSTANCES) -> DataFrame:
    """Runs (y, x0, x1, instance) of boxes (ordinal, bbox), x1 not in: ends half-even rounded and clamped, later ones above.

    Ordinals are cut to `most`, by default what 16 bits hold as in instance masks of files; with None every box keeps its own. A box is a row of each line of pixels that it meets, whatever its width. Lines are dealt by range; a task holds the boxes of one.
    """
    end = lambda i, limit: F.greatest(F.lit(0), F.least(F.lit(limit), F.rint(F.col("bbox")[i]).cast("int")))
    ordinal = F.col("ordinal") if most is None else F.least(F.col("ordinal"), F.lit(most))
    rows = boxes.select(ordinal.cast("long").alias("ordinal"), end(0, width).alias("a"), end(1, height).alias("b"), end(2, width).alias("c"), end(3, height).alias("d"))
    rows = rows.filter((F.col("c") > F.col("a")) & (F.col("d") > F.col("b")))
    lines = rows.select(F.explode(F.sequence("b", F.col("d") - 1)).alias("y"), "a", "c", "ordinal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            table = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            edges = np.flatnonzero(np.r_[True, table[1:, 0] != table[:-1, 0], True]) if len(table) else np.zeros(1, np.int64)
            out = []
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if held and held[0][0, 0] != table[i, 0]:
                    out.append(painted(np.concatenate(held)))
                    held = []
                held.append(table[i:j])
            if out:
                yield _runs(np.concatenate(out))
        if held:
            yield _runs(painted(np.concatenate(held)))

    return lines.repartitionByRange("y").sortWithinPartitions("y").mapInArrow(run, "y int, x0 int, x1 int, instance long")


def painted(line: np.ndarray) -> np.ndarray:
    """(y, x0, x1, instance) of one line's boxes (y, a, c, ordinal): between all ends, the greatest ordinal."""
    line = line[np.argsort(line[:, 3], kind="stable")]
    ends = np.unique(line[:, 1:3])
    top = np.zeros(len(ends), np.int64)
    for a, c, ordinal in zip(np.searchsorted(ends, line[:, 1]).tolist(), np.searchsorted(ends, line[:, 2]).tolist(), line[:, 3].tolist(), strict=True):
        top[a:c] = ordinal + 1
    new = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])  # the last is behind all boxes
    new = np.append(new, len(ends) - 1) if new[-1] != len(ends) - 1 else new
    there = top[new[:-1]] > 0
    first, last, value = ends[new[:-1]][there], ends[new[1:]][there], top[new[:-1]][there] - 1
    return np.stack([np.full(len(first), line[0, 0]), first, last, value], axis=1)


def _runs(table: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(table[:, i], pa.int32()) for i in range(3)), pa.array(table[:, 3])], ["y", "x0", "x1", "instance"])


def burn_instances(boxes: DataFrame, width: int, height: int, most: int | None = MOST_INSTANCES) -> DataFrame:
    """Pixels (y, x, instance) of burn_runs()."""
    return burn_runs(boxes, width, height, most).select("y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), "instance")


def rotated_values(values: Column, unit: str = "auto") -> Column:
    """cx, cy, width, height, angle in degrees of five values; `auto` takes small angles as radians."""
    angle = F.get(values, F.lit(4))
    degrees = F.when(F.abs(angle) <= 6.283185307179586, F.degrees(angle)).otherwise(angle) if unit == "auto" else F.degrees(angle) if unit == "radians" else angle
    first = F.when(F.size(values) >= 5, F.get(values, F.lit(0))).otherwise(F.raise_error(F.lit("an oriented box needs five values")).cast("double"))
    return F.struct(first.alias("cx"), *[F.get(values, F.lit(i)).alias(n) for i, n in enumerate(("cy", "width", "height"), 1)], degrees.alias("angle"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(raised, F.lit(0.0), lambda s, v: s + v)
    return F.transform(raised, lambda v: v / total)


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def to_uint8(value: Column, top: Column, floating: bool) -> Column:
    """A sample for a model: fractions of at most 1 are spread over 0 to 255, then cut to it."""
    spread = F.when(top <= 1.0, value * 255.0).otherwise(value) if floating else value
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), spread))).cast("int")


def mask_polygon(mask: DataFrame, key: str) -> DataFrame:
    """The box of a mask's pixels as a polygon, by key."""
    box = F.array(F.min("x").cast("double"), F.min("y").cast("double"), (F.max("x") + 1).cast("double"), (F.max("y") + 1).cast("double"))
    return mask.groupBy(key).agg(box.alias("bbox")).withColumn("polygon", box_polygon(F.col("bbox")))


# --- previews ---------------------------------------------------------------------------------

def index_ramp(value: Column) -> Column:
    """Red, green, blue of an index in bytes, all arithmetic modulo 256 as samples of 8 bits have it."""
    scaled = F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(-1.0)))) + 1.0) * 127.5).cast("int")
    low = scaled < 128
    byte = lambda c: F.pmod(c, F.lit(256)).cast("int")
    twice, rest = byte(scaled * 2), byte((scaled - 128) * 2)
    return F.struct(F.when(low, byte(255 - twice)).otherwise(0).alias("r"), F.when(low, twice).otherwise(rest).alias("g"), F.when(low, twice).otherwise(byte(255 - rest)).alias("b"))


def min_max_bytes(value: Column, least: Column, most: Column) -> Column:
    spread = F.when(most > least, (value - least) * 255.0 / (most - least)).otherwise(value)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), spread))).cast("int")


#: Colours of classes, repeating.
PALETTE = [(0, 0, 0), (60, 180, 75), (230, 25, 75), (0, 130, 200), (245, 130, 48), (145, 30, 180)]


def class_colour(mask: Column) -> Column:
    colours = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(c, "rgb", strict=True)]) for c in PALETTE])
    return F.element_at(colours, (F.pmod(mask, F.lit(len(PALETTE))) + 1).cast("int"))


def change_overlay(sample: Column, changed: Column, red: bool) -> Column:
    return F.when(changed, F.floor(0.65 * sample + (0.35 * 255 if red else 0.0))).otherwise(sample).cast("int")
