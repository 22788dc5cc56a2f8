"""Scene descriptions, class maps and the model registry."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.affine import pixel_area, resolution


def inspect(rasters: DataFrame) -> DataFrame:
    """Adds pixel_size, area_per_pixel, is_georeferenced and a warning to descriptions (crs, transform)."""
    known = F.col("crs").isNotNull() & (F.col("crs") != "")
    t = F.col("transform")
    return rasters.withColumns({"pixel_size": resolution(t), "area_per_pixel": pixel_area(t), "is_georeferenced": known, "warning": F.when(~known, "no CRS")})


def validate_path(path: str) -> str:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if os.path.isdir(path):
        raise IsADirectoryError(path)
    if not os.access(path, os.R_OK):
        raise PermissionError(path)
    return path


def load_yaml(path: str) -> Any:
    import yaml

    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file)


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """class_id, class_name, color of a YAML file with or without `classes`; none of a missing file."""
    body = load_yaml(path) if os.path.exists(path) else {}
    classes = (body or {}).get("classes", body) or {}
    rows = [(int(k), v.get("name", f"class_{k}") if isinstance(v, dict) else str(v), v.get("color") if isinstance(v, dict) else None) for k, v in classes.items() if str(k).lstrip("-").isdigit()]
    return spark.createDataFrame(rows, "class_id int, class_name string, color string")


# The deterministic model of each task.
DEFAULT_MODELS = {
    "object_detection": "fake_detection", "oriented_detection": "fake_oriented_detection", "semantic_segmentation": "fake_segmentation", "instance_segmentation": "fake_instance",
    "change_detection": "fake_change", "super_resolution": "fake_super_resolution",
}
RUNNERS = ("inprocess", "subprocess")


class BackendUnavailable(RuntimeError):
    """A model whose framework or weights are not here."""


class Models:
    """Model descriptions by id; an unknown id, or one of another task, falls back to the task's default."""

    def __init__(self, path: str | None = None):
        self.known = {m: {"id": m, "task": t, "backend": "fake", "framework": "numpy", "weights": None} for t, m in DEFAULT_MODELS.items()}
        for model in (load_yaml(path) or {}).get("models", []) if path else []:
            old = self.known.get(model["id"], {})
            apart = lambda m: str(m.get("runner") or "").lower() == "subprocess"
            # the later of two descriptions counts, but for one that would take a worker's own process away
            if not (model["id"].endswith("_subprocess") and apart(old) and not apart(model)):
                self.known[model["id"]] = model

    def list(self) -> list[dict]:
        return [self.known[k] for k in sorted(self.known)]

    def resolve(self, task: str, model_id: str | None = None, **overrides: Any) -> dict:
        model = self.known.get(model_id or "")
        fell_back = model is None or model["task"] != task
        if fell_back:
            model = self.known[DEFAULT_MODELS[task]]
        return model | {k: v for k, v in overrides.items() if v is not None} | ({"fallback_from": model_id} if fell_back and model_id else {})

    def check(self, model: dict) -> dict:
        """Raises where this model can't run here."""
        runner = str(model.get("runner") or "inprocess").lower()
        if runner == "http":
            raise NotImplementedError("the http runner is reserved")
        if runner not in RUNNERS:
            raise ValueError(f"unknown runner {runner!r}")
        from ..operators.adapters import available

        if runner != "subprocess" and str(model.get("backend", "fake")).lower() not in ("fake", "fake_external") and not available(model):
            raise BackendUnavailable(f"{model['id']}: {model.get('backend')} has no framework or weights here")
        return model
