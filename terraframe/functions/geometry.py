"""Columns for boxes [x1, y1, x2, y2] and polygons, arrays of struct<x, y>, in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .affine import pixel_to_geo

EDGE_MARGIN = 2.0


def _at(box: Column, i: int) -> Column:
    return box.getItem(i)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def clip_box(box: Column, width: Column, height: Column) -> Column:
    return F.array(*[F.greatest(F.lit(0.0), F.least(limit.cast("double"), _at(box, i))) for i, limit in enumerate((width, height, width, height))])


def is_empty(box: Column) -> Column:
    return (_at(box, 2) <= _at(box, 0)) | (_at(box, 3) <= _at(box, 1))


def translate_box(box: Column, dx: Column, dy: Column) -> Column:
    return F.array(*[_at(box, i) + d for i, d in enumerate((dx, dy, dx, dy))])


def translate_polygon(polygon: Column, dx: Column, dy: Column) -> Column:
    return F.transform(polygon, lambda p: point(p["x"] + dx, p["y"] + dy))


def box_area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), _at(box, 2) - _at(box, 0)) * F.greatest(F.lit(0.0), _at(box, 3) - _at(box, 1))


def touches_edge(box: Column, width: Column, height: Column, margin: float = EDGE_MARGIN) -> Column:
    return (_at(box, 0) <= margin) | (_at(box, 1) <= margin) | (_at(box, 2) >= width - margin) | (_at(box, 3) >= height - margin)


def box_polygon(box: Column) -> Column:
    """Closed ring of five points."""
    x1, y1, x2, y2 = (_at(box, i) for i in range(4))
    return F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2), point(x1, y1))


def rotated_box_polygon(cx: Column, cy: Column, width: Column, height: Column, degrees: Column) -> Column:
    """Closed ring of the corners, turned about the centre."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))

    def corner(u: float, v: float) -> Column:
        dx, dy = width * u, height * v
        return point(cx + dx * c - dy * s, cy + dx * s + dy * c)

    ring = [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5)]
    return F.array(*[corner(u, v) for u, v in ring])


def polygon_bounds(polygon: Column) -> Column:
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def to_geo(polygon: Column, t: Column) -> Column:
    return F.transform(polygon, lambda p: pixel_to_geo(t, p["x"], p["y"]))


def closed(polygon: Column) -> Column:
    """The ring with its first point at its end; an empty one is an error."""
    first = F.element_at(polygon, 1)
    ring = F.when(F.element_at(polygon, -1) == first, polygon).otherwise(F.concat(polygon, F.array(first)))
    return F.when(F.size(polygon) > 0, ring).otherwise(F.raise_error(F.lit("a polygon needs points")))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is."""
    w = F.greatest(F.lit(0.0), F.least(_at(a, 2), _at(b, 2)) - F.greatest(_at(a, 0), _at(b, 0)))
    h = F.greatest(F.lit(0.0), F.least(_at(a, 3), _at(b, 3)) - F.greatest(_at(a, 1), _at(b, 1)))
    union = box_area(a) + box_area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def shoelace_area(ring: Column) -> Column:
    """Area of a ring; 0 with fewer than four points."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(ring) >= 4, F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)) / 2).otherwise(F.lit(0.0))
