"""Scene files as a Spark data source, `terraframe_scene`: a scan opens the strips or tiles that it needs, and no others.

    spark.dataSource.register(SceneSource)
    spark.read.format("terraframe_scene").option("bands", "1,3").option("window", "0,0,512,512").load("scene.tif")

A file is split into parts (strips, tiles) and runs of parts into tasks. The option `window` (x, y, width, height) and
filters on y and x choose parts before anything is read; `bands` (from 1) chooses planes of planar files and NPZ containers.
Spark hands filters to sources in Python where `spark.sql.python.filterPushdown.enabled` is set; elsewhere they
are applied above the scan and the option does the pruning. Executors must see the file's folder.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

NAME = "terraframe_scene"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Tasks of a scan at most, and pixels in a batch of rows.
TASKS, BATCH = 4096, 1 << 18


def reader_of(path: str) -> ModuleType:
    from . import npz, tiff

    with open(path, "rb") as file:
        head = file.read(4)
    if head[:2] in (b"II", b"MM"):
        return tiff
    if head[:2] == b"PK":
        return npz
    raise ValueError(f"{path}: neither a TIFF file nor an NPZ container")


class Run(InputPartition):
    """Parts of one row of parts, from one to another."""

    def __init__(self, down: int, left: int, right: int, last: int):
        self.down, self.left, self.right, self.last = down, left, right, last


class SceneSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _info(self) -> dict:
        return reader_of(self.options["path"]).describe(self.options["path"])

    def _bands(self, info: dict) -> list[int]:
        chosen = [int(b) for b in self.options["bands"].split(",") if b] if "bands" in self.options else range(1, info["count"] + 1)
        if any(not 1 <= b <= info["count"] for b in chosen):
            raise ValueError(f"bands are numbered from 1 to {info['count']}")
        return list(chosen)

    def schema(self) -> str:
        info = self._info()
        kind = "long" if np.issubdtype(np.dtype(info["dtype"]), np.integer) else "double"
        return ", ".join(["y long", "x long", *(f"b{b} {kind}" for b in self._bands(info))])

    def reader(self, schema: StructType) -> SceneReader:
        info = self._info()
        window = tuple(int(v) for v in self.options["window"].split(",")) if "window" in self.options else None
        kind = PushedSceneReader if self.options.get("pushdown") == "true" else SceneReader
        return kind(info, self._bands(info), window)

    def writer(self, schema: StructType, overwrite: bool):
        from .tiff import SceneWriter

        return SceneWriter(self.options["path"], pickle.loads(bytes.fromhex(self.options["layout"])))


class SceneReader(DataSourceReader):
    def __init__(self, info: dict, bands: list[int], window: tuple[int, int, int, int] | None):
        self.info, self.bands = info, bands
        x, y, width, height = window or (0, 0, info["width"], info["height"])
        # first and end of rows and columns that are read
        self.low = {"y": max(0, y), "x": max(0, x)}
        self.end = {"y": min(info["height"], y + height), "x": min(info["width"], x + width)}

    def partitions(self) -> list[Run]:
        high, wide = self.info["high"], self.info["wide"]
        if any(self.low[c] >= self.end[c] for c in "yx"):
            return []
        top, bottom = self.low["y"] // high, -(-self.end["y"] // high)
        left, right = self.low["x"] // wide, -(-self.end["x"] // wide)
        most = min(TASKS, self.info.get("tasks", TASKS))
        if bottom - top >= most:  # several rows of parts a task
            step = -(-(bottom - top) // most)
            return [Run(d, left, right, min(bottom, d + step)) for d in range(top, bottom, step)]
        pieces = min(right - left, max(1, most // (bottom - top)))
        step = -(-(right - left) // pieces)
        return [Run(d, a, min(right, a + step), d + 1) for d in range(top, bottom) for a in range(left, right, step)]

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one task where there are none to read
            return
        names = ["y", "x", *(f"b{b}" for b in self.bands)]
        kind = np.int64 if np.issubdtype(np.dtype(self.info["dtype"]), np.integer) else np.float64
        blocks = reader_of(self.info["path"]).Blocks(self.info)
        try:
            for down in range(partition.down, partition.last):
                for across in range(partition.left, partition.right):
                    data = blocks.read(down, across, [b - 1 for b in self.bands])
                    top, left = down * self.info["high"], across * self.info["wide"]
                    y0, x0 = max(0, self.low["y"] - top), max(0, self.low["x"] - left)
                    data = data[:, y0 : self.end["y"] - top, x0 : self.end["x"] - left]
                    step = max(1, BATCH // max(1, data.shape[2]))
                    for first in range(0, data.shape[1], step):
                        part = data[:, first : first + step]
                        y, x = np.divmod(np.arange(part.shape[1] * part.shape[2]), max(1, part.shape[2]))
                        values = [pa.array(np.ascontiguousarray(b).ravel().astype(kind)) for b in part]
                        yield pa.RecordBatch.from_arrays([pa.array(y + (top + y0 + first)), pa.array(x + (left + x0)), *values], names)
        finally:
            blocks.close()


class PushedSceneReader(SceneReader):
    """A reader that takes comparisons of y and x with whole numbers over from Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and len(f.attribute) == 1 else None
            if column not in ("y", "x") or not isinstance(f.value, int):
                yield f
                continue
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.low[column] = max(self.low[column], f.value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                self.end[column] = min(self.end[column], f.value + (not isinstance(f, LessThan)))


def read(spark: SparkSession, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """y, x and b<number> of the bands, all by default; integer samples as longs, others as doubles. Only parts that the window (x, y, width, height) meets are read."""
    spark.dataSource.register(SceneSource)
    source = spark.read.format(NAME).option("pushdown", spark.conf.get(PUSHDOWN, "false"))
    if bands is not None:
        source = source.option("bands", ",".join(map(str, bands)))
    if window is not None:
        source = source.option("window", ",".join(map(str, window)))
    return source.load(path)


def save(rows: DataFrame, path: str, layout: object) -> None:
    rows.sparkSession.dataSource.register(SceneSource)
    rows.write.format(NAME).option("layout", pickle.dumps(layout).hex()).mode("append").save(path)
