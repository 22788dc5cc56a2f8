"""Models over tiles: a contract for plug-ins, the plans that run one per tile, and models in a process of their own.

A model is loaded once per task, sees that task's tiles one after another and is closed after the last.
A tile arrives as an array (band, row, column) with its place; what the model returns becomes rows, in
places of the whole scene. Deterministic models of reference need none of this: they are columns (see
raster_ops) and never leave the JVM.
"""

from __future__ import annotations

import atexit
import importlib
import importlib.util
import json
import os
import subprocess
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tiles
from . import stitching
from .jobs import plain

# The names in requests and responses of models in their own process are those of _ask below.
DETECTION = "tile_seq int, idx int, label string, class_id int, score double, bbox array<double>, rotated array<double>, polygon array<struct<x:double,y:double>>"
DETECTION_ARROW = pa.schema([
    ("tile_seq", pa.int32()), ("idx", pa.int32()), ("label", pa.string()), ("class_id", pa.int32()), ("score", pa.float64()), ("bbox", pa.list_(pa.float64())), ("rotated", pa.list_(pa.float64())),
    ("polygon", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))),
])
DETECTION_NAMES = DETECTION_ARROW.names
#: Fixed value: how long a model in its own process may take for a tile where its description doesn't say.
SECONDS = 600


class Adapter:
    """What a plug-in implements; only what its task asks for. Places are those of the tile."""

    def load(self) -> None:
        """Before a task's first tile."""

    def predict(self, tile: np.ndarray, info: dict[str, Any]) -> Iterable[dict]:
        """Dicts of label, score, class_id, bbox, and of rotated boxes (cx, cy, width, height, angle_degrees) or polygon points."""
        raise NotImplementedError

    def probabilities(self, tile: np.ndarray, info: dict[str, Any]) -> np.ndarray:
        """(class, row, column)."""
        raise NotImplementedError

    def change(self, before: np.ndarray, after: np.ndarray, info: dict[str, Any]) -> np.ndarray:
        """Probability of change (row, column)."""
        raise NotImplementedError

    def upscale(self, tile: np.ndarray, scale: int, info: dict[str, Any]) -> np.ndarray:
        """(band, row * scale, column * scale)."""
        raise NotImplementedError

    def close(self) -> None:
        """After a task's last tile."""


Make = Callable[[], Adapter]


def _tiles(frames: Iterable[pd.DataFrame], bands: list[str]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """tile_seq, x0, y0 and the array of every tile of rows sorted by tile."""

    def array(rows: pd.DataFrame) -> tuple[int, int, int, np.ndarray]:
        x0, y0 = int(rows.tile_x0.iloc[0]), int(rows.tile_y0.iloc[0])
        x, y = (rows.x - x0).to_numpy(int), (rows.y - y0).to_numpy(int)
        data = np.zeros((len(bands), y.max() + 1, x.max() + 1))
        for i, name in enumerate(bands):
            data[i, y, x] = rows[name]
        return int(rows.tile_seq.iloc[0]), x0, y0, data

    held: list[pd.DataFrame] = []
    for frame in frames:
        for seq, rows in frame.groupby("tile_seq", sort=False):
            if held and held[0].tile_seq.iloc[0] != seq:
                yield array(pd.concat(held))
                held = []
            held.append(rows)
    if held:
        yield array(pd.concat(held))


def _by_tile(pixels: DataFrame, bands: list[str], size: tuple[int, int], tile: int, overlap: int, make: Make, use: Callable[[Adapter, int, int, int, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Rows that `use` gives for each tile; a task holds one tile's pixels at a time, a bounded group."""
    assigned = tiles.assign(pixels, *size, tile, overlap).select("tile_seq", "tile_x0", "tile_y0", "y", "x", *[F.col(b) for b in bands])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adapter = None
        try:
            for seq, x0, y0, data in _tiles(frames, bands):
                if adapter is None:
                    adapter = make()
                    adapter.load()
                yield use(adapter, seq, x0, y0, data)
        finally:
            if adapter is not None:
                adapter.close()

    return assigned.repartition("tile_seq").sortWithinPartitions("tile_seq").mapInPandas(run, schema)


def detect(pixels: DataFrame, bands: list[str], size: tuple[int, int], make: Make, tile: int = 512, overlap: int = 64, score: float = 0.0, clip: bool = True) -> DataFrame:
    """Rows of DETECTION in places of the whole scene. With `clip` boxes are clipped to it and empty ones left out; low scores are always.

    size: width and height. `rotated` is cx, cy, width, height and the angle in degrees.
    """
    def use(adapter: Adapter, seq: int, x0: int, y0: int, data: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(_records(adapter, seq, x0, y0, data, size, score, clip), columns=DETECTION_NAMES)

    return _by_tile(pixels, bands, size, tile, overlap, make, use, DETECTION)


def _records(adapter: Adapter, seq: int, x0: int, y0: int, data: np.ndarray, size: tuple[int, int], score: float, clip: bool) -> list[tuple]:
    """A tile's rows of DETECTION."""
    width, height = size
    out = []
    for n, found in enumerate(adapter.predict(data, {"tile_seq": seq, "x0": x0, "y0": y0}), 1):
        turned, ring = found.get("rotated_box"), found.get("polygon") or found.get("mask_polygon")
        if turned is not None:
            turned = [float(turned["cx"]) + x0, float(turned["cy"]) + y0, *(float(turned[k]) for k in ("width", "height", "angle_degrees"))]
        if ring is not None:
            ring = [{"x": float(x) + x0, "y": float(y) + y0} for x, y in ring]
        a, b, c, d = found.get("bbox") or (0, 0, 0, 0)
        box = [float(v) for v in (a + x0, b + y0, c + x0, d + y0)]
        if clip:
            box = [min(max(v, 0.0), float(limit)) for v, limit in zip(box, (width, height, width, height), strict=True)]
        if float(found.get("score", 0.0)) >= score and (not clip or (box[2] > box[0] and box[3] > box[1])):
            out.append((seq, n, str(found.get("label", "target")), int(found.get("class_id") or 0), float(found.get("score", 0.0)), box, turned, ring))
    return out


#: The model that a worker holds for SQL functions, by the function's registration.
_loaded: dict[str, Adapter] = {}


def _held(name: str, make: Make) -> Adapter:
    """Spark makes a table function anew for every partition, so its model is kept by the worker: until another one is asked for, or it ends."""
    if name not in _loaded:
        _close_held()
        adapter = make()
        adapter.load()
        _loaded[name] = adapter
    return _loaded[name]


def _close_held() -> None:
    while _loaded:
        _loaded.popitem()[1].close()


atexit.register(_close_held)


def register(spark: SparkSession, name: str, make: Make, bands: list[str], size: tuple[int, int], clip: bool = True) -> None:
    """A table function of SQL that runs a detector over tiles: 0 to n rows of DETECTION for each, as detect() gives them.

        SELECT * FROM detect(TABLE(tiles) PARTITION BY (tile_seq), 0.25)

    The table has tile_seq, tile_x0, tile_y0, y, x and the bands (`tiles.assign` makes it); the number is the least score. Pixels come in
    Arrow batches. Functions over these have a fixed type and no `analyze`, so each kind of task would be a function of its own.
    """
    which = uuid.uuid4().hex

    class Detector:
        def __init__(self) -> None:
            self.batches: list[pa.RecordBatch] = []
            self.score = 0.0

        def eval(self, table: pa.RecordBatch, score: pa.Array) -> Iterator[pa.Table]:
            self.batches.append(table)
            if len(score) and score[0].is_valid:
                self.score = float(score[0].as_py())
            return iter(())

        def terminate(self) -> Iterator[pa.Table]:
            frames = [pa.Table.from_batches(self.batches).to_pandas()] if sum(map(len, self.batches)) else []
            adapter = _held(which, make) if frames else None
            for seq, x0, y0, data in _tiles(frames, bands):
                rows = _records(adapter, seq, x0, y0, data, size, self.score, clip)
                yield pa.Table.from_pylist([dict(zip(DETECTION_NAMES, r, strict=True)) for r in rows], DETECTION_ARROW)

    spark.udtf.register(name, F.arrow_udtf(returnType=DETECTION)(Detector))


def _places(x0: int, y0: int, high: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.divmod(np.arange(high * wide), wide)
    return y + y0, x + x0


def segment(pixels: DataFrame, bands: list[str], size: tuple[int, int], make: Make, tile: int = 512, overlap: int = 64) -> DataFrame:
    """y, x, probs (by class) and class_id: tiles' probabilities blended by their centre weights."""

    def use(adapter: Adapter, seq: int, x0: int, y0: int, data: np.ndarray) -> pd.DataFrame:
        found = np.asarray(adapter.probabilities(data, {"tile_seq": seq, "x0": x0, "y0": y0}), float)
        y, x = _places(x0, y0, *found.shape[1:])
        return pd.DataFrame({"y": y, "x": x, "x0": x0, "y0": y0, "wide": found.shape[2], "high": found.shape[1], "probs": list(found.reshape(len(found), -1).T)})

    rows = _by_tile(pixels, bands, size, tile, overlap, make, use, "y long, x long, x0 int, y0 int, wide int, high int, probs array<double>")
    weight = stitching.centre_weight(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), F.col("wide"), F.col("high"))
    rows = rows.select("y", "x", weight.alias("w"), F.posexplode("probs").alias("c", "p"))
    rows = stitching.stitch(rows, "p", ["y", "x", "c"], F.col("w"))
    # a pixel has a row for each class
    by_class = F.array_sort(F.collect_list(F.struct("c", "p")))
    out = rows.groupBy("y", "x").agg(F.transform(by_class, lambda s: s["p"]).alias("probs"))
    return out.withColumn("class_id", stitching.argmax(F.col("probs")))


def change(before: DataFrame, after: DataFrame, bands: list[str], size: tuple[int, int], make: Make, tile: int = 512, overlap: int = 64) -> DataFrame:
    """y, x and probability, blended over tiles; pixels that one date lacks are left out."""
    later = after.select("y", "x", *[F.col(b).alias(f"{b}__after") for b in bands])
    both = before.select("y", "x", *bands).join(later, ["y", "x"])

    def use(adapter: Adapter, seq: int, x0: int, y0: int, data: np.ndarray) -> pd.DataFrame:
        found = np.asarray(adapter.change(data[: len(bands)], data[len(bands) :], {"tile_seq": seq, "x0": x0, "y0": y0}), float)
        y, x = _places(x0, y0, *found.shape)
        return pd.DataFrame({"y": y, "x": x, "x0": x0, "y0": y0, "wide": found.shape[1], "high": found.shape[0], "probability": found.ravel()})

    rows = _by_tile(both, [*bands, *(f"{b}__after" for b in bands)], size, tile, overlap, make, use, "y long, x long, x0 int, y0 int, wide int, high int, probability double")
    weight = stitching.centre_weight(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), F.col("wide"), F.col("high"))
    return stitching.stitch(rows, "probability", ["y", "x"], weight)


def upscale(pixels: DataFrame, bands: list[str], size: tuple[int, int], scale: int, make: Make, tile: int = 256, overlap: int = 32, dtype: str = "uint8") -> DataFrame:
    """y, x and the bands on a grid of `scale` times as many pixels each way, blended over tiles."""

    def use(adapter: Adapter, seq: int, x0: int, y0: int, data: np.ndarray) -> pd.DataFrame:
        found = np.asarray(adapter.upscale(data, scale, {"tile_seq": seq, "x0": x0, "y0": y0}), float)
        y, x = _places(x0 * scale, y0 * scale, *found.shape[1:])
        return pd.DataFrame({"y": y, "x": x, "x0": x0 * scale, "y0": y0 * scale, "wide": found.shape[2], "high": found.shape[1]} | {b: found[i].ravel() for i, b in enumerate(bands)})

    rows = _by_tile(pixels, bands, size, tile, overlap, make, use, "y long, x long, x0 int, y0 int, wide int, high int, " + ", ".join(f"`{b}` double" for b in bands))
    weight = stitching.centre_weight(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), F.col("wide"), F.col("high"))
    total = F.greatest(F.sum("__w"), F.lit(stitching.LEAST_TOTAL))
    out = rows.withColumn("__w", weight).groupBy("y", "x").agg(*[(F.sum(F.col(b) * F.col("__w")) / total).alias(b) for b in bands])
    return out.select("y", "x", *[stitching.to_samples(F.col(b), dtype).alias(b) for b in bands])


class SubprocessAdapter(Adapter):
    """A model in a process of its own, started for each tile: arrays and JSON go through a temporary folder of the worker.

    The module `entrypoint` gets --request and --response. A failing process, a missing or negative
    response and a timeout are RuntimeErrors, which fail the task.
    """

    def __init__(self, model: dict[str, Any], **options: Any):
        self.model, self.options = dict(model), options
        self.entrypoint, self.environment = str(model.get("entrypoint") or ""), model.get("conda_env")
        self.seconds = int(model.get("runner_timeout_sec") or SECONDS)
        if not self.entrypoint:
            raise ValueError(f"model {model.get('id')!r} runs as a subprocess and has no entrypoint")

    def _ask(self, arrays: dict[str, np.ndarray], info: dict, **more: Any) -> dict:
        who = f"worker {self.entrypoint} of model {self.model.get('id')}"
        with tempfile.TemporaryDirectory(prefix="model_") as folder:
            paths = {}
            for name, data in arrays.items():
                paths[name] = os.path.join(folder, f"{name}.npy")
                np.save(paths[name], data)
            request, response = os.path.join(folder, "request.json"), os.path.join(folder, "response.json")
            known = {k: v for k, v in self.model.items() if k not in ("runner", "conda_env", "entrypoint", "runner_timeout_sec")}
            with open(request, "w", encoding="utf-8") as file:
                json.dump({"model_config": known, "task": self.model.get("task"), "backend": self.model.get("backend"), "tile_info": info, "arrays": paths, "kwargs": self.options | more}, file, default=plain)
            command = [*(["conda", "run", "-n", self.environment, "python"] if self.environment else [sys.executable]), "-m", self.entrypoint, "--request", request, "--response", response]
            try:
                done = subprocess.run(command, env=os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, sys.path))}, text=True, capture_output=True, timeout=self.seconds, check=False)
            except subprocess.TimeoutExpired as error:
                raise RuntimeError(f"{who} took more than {self.seconds} s") from error
            except FileNotFoundError as error:
                raise RuntimeError(f"{who}: {command[0]!r} is not here") from error
            if done.returncode:
                raise RuntimeError(f"{who} failed with {done.returncode}: {done.stderr.strip()}")
            if not os.path.exists(response):
                raise RuntimeError(f"{who} gave no response")
            with open(response, encoding="utf-8") as file:
                found = json.load(file)
            if not found.get("ok", True):
                raise RuntimeError(f"{who}: {found.get('error', 'unknown error')}")
            return found | {k.removesuffix("_path"): np.load(found[k], allow_pickle=False) for k in ("mask_path", "probability_path", "image_path") if found.get(k)}

    def _part(self, found: dict, name: str) -> np.ndarray:
        if name not in found:
            raise RuntimeError(f"worker {self.entrypoint} gave no {name}_path")
        return found[name]

    def predict(self, tile: np.ndarray, info: dict[str, Any]) -> Iterable[dict]:
        return self._ask({"tile": tile}, info).get("predictions", [])

    def probabilities(self, tile: np.ndarray, info: dict[str, Any]) -> np.ndarray:
        found = self._ask({"tile": tile}, info)
        if "probability" in found:
            return found["probability"]
        mask = self._part(found, "mask")
        return (mask[None] == np.arange(int(mask.max(initial=0)) + 1)[:, None, None]).astype(float)

    def change(self, before: np.ndarray, after: np.ndarray, info: dict[str, Any]) -> np.ndarray:
        return self._part(self._ask({"tile": before, "tile_t2": after}, info), "probability")

    def upscale(self, tile: np.ndarray, scale: int, info: dict[str, Any]) -> np.ndarray:
        return self._part(self._ask({"tile": tile}, info, scale=scale), "image")


#: Makers of adapters by task and backend, for models that run within Spark's Python workers; `backend` adds to it.
BACKENDS: dict[tuple[str, str], Callable[[dict], Adapter]] = {}
#: The backend of models that name their adapter themselves, as `entrypoint: module:Class`.
PYTHON = "python"


def backend(task: str, name: str) -> Callable[[Callable[[dict], Adapter]], Callable[[dict], Adapter]]:
    """Makes what it decorates the maker of adapters of a task's models with that backend; it is called in workers, with the model's description."""

    def add(make: Callable[[dict], Adapter]) -> Callable[[dict], Adapter]:
        BACKENDS[task, name.lower()] = make
        return make

    return add


def _entry(model: dict) -> tuple[str, str]:
    module, _, name = str(model.get("entrypoint") or "").partition(":")
    if not module or not name:
        raise ValueError(f"model {model.get('id')!r} needs an entrypoint, module:Class")
    return module, name


def available(model: dict) -> bool:
    """Whether a model that isn't deterministic can run in workers: its backend is known, or its own module is there."""
    kind = str(model.get("backend", "fake")).lower()
    if (str(model.get("task")), kind) in BACKENDS:
        return True
    if kind != PYTHON:
        return False
    try:
        return importlib.util.find_spec(_entry(model)[0]) is not None
    except ModuleNotFoundError:
        return False


def maker(model: dict, **options: Any) -> Make | None:
    """What makes the adapter of a (checked) model description; None of a deterministic one, which is a plan."""
    if str(model.get("runner") or "inprocess").lower() == "subprocess":
        SubprocessAdapter(model)  # says here what is missing
        return lambda: SubprocessAdapter(model, **options)
    kind = str(model.get("backend", "fake")).lower()
    made = BACKENDS.get((str(model.get("task")), kind))
    if made is not None:
        return lambda: made(model | options)
    if kind == PYTHON:
        module, name = _entry(model)
        return lambda: getattr(importlib.import_module(module), name)(model | options)
    return None
