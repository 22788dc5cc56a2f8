"""Tile grids as arithmetic: no lists of tiles are joined with pixels.

Along an axis of length L, tiles of T pixels start every s = T - overlap pixels. `shift` grids move the
last tile back so that it is whole; `shrink` grids cut it at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tile size and overlap by task, and of any other task.
TASK_TILES = {
    "detection": (1024, 192), "object_detection": (1024, 192), "oriented_detection": (1024, 192), "instance_segmentation": (1024, 192),
    "segmentation": (1024, 128), "semantic_segmentation": (1024, 128), "change_detection": (1024, 128), "super_resolution": (256, 32),
}
OTHER_TILES = (1024, 128)
RUN_TILES = (512, 64)
SHOWN = 20


def validate(tile: int, overlap: int) -> None:
    if tile <= 0:
        raise ValueError("tile size must be positive")
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    if overlap >= tile:
        raise ValueError("overlap must be less than the tile size")


def tiles_along(length: int, tile: int, overlap: int) -> int:
    return 1 if length <= tile else -(-(length - tile) // (tile - overlap)) + 1


def grid(spark: SparkSession, width: int, height: int, tile: int, overlap: int, edge: str = "shift") -> DataFrame:
    """tile_seq, tile_id, row, col, x0, y0, x1, y1 in row-major order; ends are exclusive."""
    validate(tile, overlap)
    if width <= 0 or height <= 0:
        raise ValueError("width and height must be positive")
    across, down, step = tiles_along(width, tile, overlap), tiles_along(height, tile, overlap), tile - overlap
    seq = F.col("id")
    rows = spark.range(across * down).select(seq.cast("int").alias("tile_seq"), F.floor(seq / across).cast("int").alias("row"), (seq % across).cast("int").alias("col"))

    def start(i: Column, n: int, length: int) -> Column:
        last = max(0, length - tile) if edge == "shift" else (n - 1) * step
        return F.when(i == n - 1, F.lit(last)).otherwise(i * step).cast("int")

    name = F.format_string("tile_%05d", "tile_seq") if edge == "shift" else F.format_string("r%04d_c%04d", "row", "col")
    rows = rows.withColumns({"tile_id": name, "x0": start(F.col("col"), across, width), "y0": start(F.col("row"), down, height)})
    return rows.withColumns({"x1": F.least(F.col("x0") + tile, F.lit(width)), "y1": F.least(F.col("y0") + tile, F.lit(height))}).select("tile_seq", "tile_id", "row", "col", "x0", "y0", "x1", "y1")


def containing(coordinate: Column, length: int, tile: int, overlap: int) -> Column:
    """Numbers of the shifted tiles along one axis that hold a coordinate."""
    step, n = tile - overlap, tiles_along(length, tile, overlap)
    if n == 1:
        return F.array(F.lit(0))
    first = F.greatest(F.lit(0), F.ceil((coordinate - (tile - 1)) / step)).cast("int")
    last = F.least(F.lit(n - 2), F.floor(coordinate / step)).cast("int")
    regular = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.when(coordinate >= max(0, length - tile), F.concat(regular, F.array(F.lit(n - 1)))).otherwise(regular)


def assign(pixels: DataFrame, width: int, height: int, tile: int, overlap: int) -> DataFrame:
    """A row per pixel and tile that holds it: adds tile_seq, tile_x0 and tile_y0 of the shifted grid."""
    validate(tile, overlap)
    across, down, step = tiles_along(width, tile, overlap), tiles_along(height, tile, overlap), tile - overlap
    rows = pixels.withColumn("__row", F.explode(containing(F.col("y"), height, tile, overlap))).withColumn("__col", F.explode(containing(F.col("x"), width, tile, overlap)))
    start = lambda i, n, length: F.when(i == n - 1, F.lit(max(0, length - tile))).otherwise(i * step).cast("int")
    return rows.withColumns({
        "tile_seq": (F.col("__row") * across + F.col("__col")).cast("int"), "tile_x0": start(F.col("__col"), across, width), "tile_y0": start(F.col("__row"), down, height),
    }).drop("__row", "__col")


def preflight(spark: SparkSession, width: int, height: int, task: str, tile: int | None = None, overlap: int | None = None) -> DataFrame:
    """One row: the plan of a run, its number of tiles and the first SHOWN of them."""
    default = TASK_TILES.get(task, OTHER_TILES)
    tile, overlap = tile or default[0], default[1] if overlap is None else overlap
    rows = grid(spark, width, height, tile, overlap, edge="shrink")
    count = tiles_along(width, tile, overlap) * tiles_along(height, tile, overlap)
    shown = rows.filter(F.col("tile_seq") < SHOWN).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile_seq", "tile_id"))), lambda t: t["tile_id"]), ",").alias("windows"))
    return shown.select(F.lit(task).alias("task"), F.lit(tile).alias("tile_size"), F.lit(overlap).alias("overlap"), F.lit(count).cast("long").alias("tile_count"), "windows", F.lit(count > SHOWN).alias("windows_truncated"))
