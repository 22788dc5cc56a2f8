"""Connected components of masks (4 neighbours), in runs of pixels.

A row's pixels form runs; runs of successive rows are linked where a pixel of one stands above a pixel
of the other, by an equal-key join of pixels, so wide rows cost no more than their pixels. Components
are then those of the graph of runs, whose least run is the component's first pixel in scan order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components, cut
from .ranks import ranked


def components(mask: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, first_y, first_x, pixel_count, x0, y0, x1, y1 (exclusive ends) of each component of the mask's pixels.

    `mask` has a row per pixel that is set: keys, y, x. Pixels of different keys are never linked.
    """
    keys = keys or []
    line = Window.partitionBy(*keys, "y").orderBy("x")
    pixels = mask.select(*keys, "y", "x").withColumn("__g", F.col("x") - F.row_number().over(line))
    first = F.min("x").over(Window.partitionBy(*keys, "y", "__g"))
    # ids of runs rise in scan order within a key, and differ between keys
    place = F.shiftleft(F.col("y").cast("long"), 32) + first.cast("long")
    run = F.concat(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), F.format_string("/%019d", place)) if keys else place
    pixels = cut(pixels.withColumn("run", run).drop("__g"))
    below = pixels.select(*[F.col(k).alias(f"__{k}") for k in keys], (F.col("y") - 1).alias("__y"), F.col("x").alias("__x"), F.col("run").alias("__run"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    links = cut(pixels.join(below, [*same, F.col("y") == F.col("__y"), F.col("x") == F.col("__x")]).select("run", "__run").distinct())
    runs = pixels.groupBy("run").agg(*[F.first(k).alias(k) for k in keys], F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("y"))
    if links.isEmpty():
        rooted = runs.withColumn("root", F.col("run"))
    else:
        roots = connected_components(links, "run", "__run")
        rooted = runs.join(roots, F.col("run") == F.col("node"), "left").withColumn("root", F.coalesce("root", "run"))
    out = rooted.groupBy("root").agg(*[F.first(k).alias(k) for k in keys], F.min(F.struct("y", "a")).alias("first"), F.sum("n").alias("pixel_count"), F.min("a").alias("x0"), F.min("y").alias("y0"), (F.max("b") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    return out.select(*keys, F.col("first.y").alias("first_y"), F.col("first.a").alias("first_x"), "pixel_count", "x0", "y0", "x1", "y1")


def numbered(found: DataFrame, keys: list[str] | None = None, out: str = "component_id") -> DataFrame:
    """Components numbered from 1 in scan order within each key."""
    return ranked(found, keys or [], [F.col("first_y"), F.col("first_x")], out).withColumn(out, F.col(out).cast("int"))
