"""One way to read a scene: GeoTIFF or NPZ container by what the file begins with, whatever its name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.affine import DEFAULT_TRANSFORM
from . import scene_source


def describe(path: str) -> dict:
    """path, width, height, count, dtype, crs, transform, nodata, driver and fallback_container."""
    info = scene_source.reader_of(path).describe(path)
    keep = ("path", "width", "height", "count", "dtype", "crs", "transform", "nodata", "driver", "fallback_container")
    return {k: info[k] for k in keep} | {"transform": tuple(info["transform"] or DEFAULT_TRANSFORM)}


def read_scene(spark: SparkSession, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """y, x and b<number>, places in the whole scene, of the bands (from 1) and the window (x, y, width, height): only parts of the file that these meet are read."""
    return scene_source.read(spark, path, bands, window)
