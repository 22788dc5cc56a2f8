"""Scenes as pixel tables, wide by band so that a scan reads only the bands asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Width of the scenes that the tables of a folder stand for.
WIDTH = 100
BANDS = ["blue", "green", "red", "nir", "swir1", "swir2"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(key: str) -> dict[str, Column]:
    return {"y": F.floor(F.col(key) / WIDTH), "x": F.col(key) % WIDTH}


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x and six bands from `events`, a row per pixel."""
    rows = _table(spark, sf_dir, "events")
    bands = {
        "blue": F.regexp_extract("props", "([0-9]+)", 1).cast("double"), "green": (F.col("user_id") % 256).cast("double"), "red": F.col("value"),
        "nir": (F.minute("ts") * 4).cast("double"), "swir1": (F.floor(F.second("ts")) * 4).cast("double"), "swir2": (F.hour("ts") * 10).cast("double"),
    }
    return rows.select(*[c.alias(n) for n, c in (_place("event_id") | bands).items()])


def later_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same place at a later date, from `orders`: y, x, red."""
    return _table(spark, sf_dir, "orders").select(*[c.alias(n) for n, c in _place("o_orderkey").items()], (F.col("o_totalprice").cast("double") % 256).alias("red"))


def size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Width and height of the scene."""
    n = _table(spark, sf_dir, "events").count()
    return WIDTH, -(-n // WIDTH)


def vector_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, bands (array) and class_id from `embeddings`, 25 pixels wide."""
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select(F.floor(F.col("vec_id") / 25).alias("y"), (F.col("vec_id") % 25).alias("x"), F.transform("embedding", lambda v: v.cast("double")).alias("bands"), F.col("label").alias("class_id"))


def vector_size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Height and width of the vector scene, by its last pixel's row."""
    last = _table(spark, sf_dir, "embeddings").agg(F.max("vec_id").alias("last")).collect()[0]["last"]
    return (last // 25 + 1 if last is not None else 0), 25


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections from `part`: raster_id, id, label, score, bbox."""
    k = F.col("p_partkey")
    x, y = (k * 37 % 400).cast("double"), (k * 91 % 300).cast("double")
    return _table(spark, sf_dir, "part").select(
        F.lit("scene").alias("raster_id"), k.alias("id"), F.col("p_brand").alias("label"), (k * 7919 % 1000 / 1000).alias("score"), F.array(x, y, x + F.col("p_size"), y + F.col("p_size")).alias("bbox")
    )


def synthetic(spark: SparkSession, width: int, height: int, bands: int = 4, changed: bool = False) -> DataFrame:
    """y, x and b1 to b<bands>: planes that rise with the band, 0 to 255; `changed` lightens a patch."""
    y, x = F.floor(F.col("id") / width), F.col("id") % width
    planes = [((x * (b + 1) + y * (b + 2)) % 255).cast("double") + F.lit(20.0) * F.sin(F.lit((b + 1) * 0.2)) for b in range(bands)]
    if bands >= 4:
        planes[3] = F.greatest(planes[3], planes[2] + 25)
    if changed:
        inside = (y >= height // 3) & (y < min(height, height // 3 + height // 5)) & (x >= width // 3) & (x < min(width, width // 3 + width // 5))
        planes = [p + F.when(inside, 80.0).otherwise(0.0) for p in planes]
    return spark.range(width * height).select(y.alias("y"), x.alias("x"), *[F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), p))).alias(f"b{i + 1}") for i, p in enumerate(planes)])


def visual_synthetic(spark: SparkSession, width: int, height: int, bands: int = 3, changed: bool = False) -> DataFrame:
    """y, x and b1 to b<bands>: gradients with a rectangle and a disc; `changed` moves the disc and adds a patch."""
    y, x = F.floor(F.col("id") / width), F.col("id") % width
    floor = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c)))
    planes = [floor(30 + x * 80 / max(width - 1, 1)), floor(40 + y * 90 / max(height - 1, 1)), floor(55 + (x + y) * 60 / max(width + height - 2, 1))]
    planes += [F.floor((planes[0] + planes[1]) / 2)] * max(0, bands - 3)
    planes = planes[:bands]
    box = lambda x0, x1, y0, y1: (x >= x0) & (x < x1) & (y >= y0) & (y < y1)
    rectangle = box(width // 5, width // 5 + max(width // 4, 8), height // 4, height // 4 + max(height // 5, 8))
    radius, cx, cy = max(min(width, height) // 9, 5), width * (3 if changed else 2) // 4, height * 2 // 3
    disc = F.pow(x - cx, 2) + F.pow(y - cy, 2) <= radius**2
    patch = box(width // 2, min(width, width // 2 + max(width // 6, 6)), height // 8, min(height, height // 8 + max(height // 6, 6)))
    # Colours of rectangle and disc by band, and of the patch.
    colours = [(220, 60), (70, 190), (60, 230)]
    out = []
    for i, plane in enumerate(planes):
        if i < 3:
            plane = F.when(disc, colours[i][1]).when(rectangle, colours[i][0]).otherwise(plane)
        out.append(F.when(patch, 245).otherwise(plane) if changed else plane)
    return spark.range(width * height).select(y.alias("y"), x.alias("x"), *[c.cast("long").alias(f"b{i + 1}") for i, c in enumerate(out)])


def window(pixels: DataFrame, x: int, y: int, width: int, height: int, bands: list[int] | None = None) -> DataFrame:
    """Pixels of a window, with places from its corner; 1-based band numbers pick b<number>. What lies outside the scene is left out."""
    if bands is not None and any(b < 1 for b in bands):
        raise ValueError("bands are numbered from 1")
    rows = pixels.filter((F.col("y") >= y) & (F.col("y") < y + height) & (F.col("x") >= x) & (F.col("x") < x + width))
    kept = [f"b{b}" for b in bands] if bands is not None else [c for c in pixels.columns if c not in ("y", "x")]
    return rows.select((F.col("y") - y).alias("y"), (F.col("x") - x).alias("x"), *kept)
