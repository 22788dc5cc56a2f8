"""Columns for affine transforms: a struct of a, b, c, d, e, f with x' = a x + b y + c, y' = d x + e y + f."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of scenes that name none.
DEFAULT_TRANSFORM = (1.0, 0.0, 500000.0, 0.0, -1.0, 4100000.0)
DEFAULT_CRS = "EPSG:3857"


def transform(values: tuple | None = None) -> Column:
    """A literal transform; further values of a nine-value one are left out, none gives the default."""
    values = DEFAULT_TRANSFORM if values is None else tuple(values)[:6]
    if len(values) != 6:
        raise ValueError("a transform has six values")
    return F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(values, "abcdef", strict=True)])


def pixel_to_geo(t: Column, x: Column, y: Column) -> Column:
    return F.struct((t["a"] * x + t["b"] * y + t["c"]).alias("x"), (t["d"] * x + t["e"] * y + t["f"]).alias("y"))


def geo_bounds(t: Column, width: Column, height: Column) -> Column:
    """xmin, ymin, xmax, ymax over the four corners."""
    corners = [pixel_to_geo(t, x, y) for x in (F.lit(0), width) for y in (F.lit(0), height)]
    xs, ys = F.array(*[c["x"] for c in corners]), F.array(*[c["y"] for c in corners])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def pixel_area(t: Column) -> Column:
    return F.abs(t["a"] * t["e"] - t["b"] * t["d"])


def resolution(t: Column) -> Column:
    return F.array(F.abs(t["a"]), F.abs(t["e"]))


def scaled(t: Column, scale: int) -> Column:
    """The transform of a grid of `scale` times as many pixels each way."""
    if scale <= 0:
        raise ValueError("scale must be positive")
    return F.struct(*[(t[n] if n in "cf" else t[n] / F.lit(float(scale))).alias(n) for n in "abcdef"])
