"""Jobs: an append-only log of states, and a synchronous runner that records what happened."""

from __future__ import annotations

import datetime
import json
import os
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("queued", "running", "success", "failed")


def latest(log: DataFrame) -> DataFrame:
    """job_id, its last status and how many updates it had; a state machine's log in one aggregate."""
    return log.groupBy("job_id").agg(F.max_by("status", "updated_at").alias("status"), F.count("*").alias("updates"))


def now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def new_job_id(prefix: str) -> str:
    return f"{prefix}_{datetime.datetime.now():%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"


def plain(value: Any) -> Any:
    """Of what JSON doesn't know: numbers and lists of numpy, what an object says of itself, else its text."""
    if hasattr(value, "tolist"):
        return value.tolist()
    return value.to_dict() if hasattr(value, "to_dict") else str(value)


FLAGS = "array<struct<code:string,severity:string,message:string>>"


def manifests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, body) of JSON files, one value a file: manifests or records of many jobs as a table. `body` is a VARIANT, null of a file that is no JSON.

    A path of it is read by `variant_get(body, '$.statistics.count', 'long')`, or by values() and flags() below. Files are packed into
    tasks by size; nothing passes through the driver.
    """
    texts = spark.read.text(paths, wholetext=True, pathGlobFilter="*.json")
    return texts.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("body"))


def values(found: DataFrame, **paths: str) -> DataFrame:
    """path, job_id, task, status and the values at paths, each `name="$.place.in.it type"`; null where it isn't there or is of another type."""
    named = {"job_id": "$.job_id string", "task": "$.task string", "status": "$.status string"} | paths
    return found.select("path", *[F.try_variant_get("body", at.rpartition(" ")[0], at.rpartition(" ")[2]).alias(n) for n, at in named.items()])


def flags(found: DataFrame) -> DataFrame:
    """path, job_id, task, code, severity and message of every quality flag."""
    rows = found.select("path", *[F.try_variant_get("body", f"$.{n}", "string").alias(n) for n in ("job_id", "task")], F.explode(F.try_variant_get("body", "$.quality_flags", FLAGS)).alias("f"))
    return rows.select("path", "job_id", "task", "f.code", "f.severity", "f.message")


class JobStore:
    """One JSON file a job in a folder of the driver; files that can't be read are left out of lists."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _path(self, job_id: str) -> str:
        return os.path.join(self.folder, f"{job_id}.json")

    def _write(self, record: dict) -> dict:
        with open(self._path(record["job_id"]), "w", encoding="utf-8") as file:
            json.dump(record, file, indent=2, ensure_ascii=False, default=plain)
        return record

    def create(self, task: str, model_id: str | None = None, inputs: list[str] | None = None, parameters: dict | None = None) -> dict:
        job_id = new_job_id(task)
        return self._write({
            "job_id": job_id, "task": task, "status": "queued", "created_at": now(), "updated_at": now(), "model_id": model_id, "input_files": inputs or [], "parameters": parameters or {},
            "output_dir": os.path.join(self.folder, job_id), "manifest_path": None, "outputs": {}, "statistics": {}, "quality_flags": [], "errors": [],
        })

    def update(self, job_id: str, **changes: Any) -> dict:
        return self._write(self.get(job_id) | changes | {"updated_at": now()})

    def get(self, job_id: str) -> dict:
        with open(self._path(job_id), encoding="utf-8") as file:
            return json.load(file)

    def list(self) -> list[dict]:
        out = []
        for name in sorted(os.listdir(self.folder)):
            if name.endswith(".json"):
                try:
                    out.append(self.get(name[:-5]))
                except (OSError, ValueError):
                    continue
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """All records as (path, body), for queries over many jobs; the folder must be one that executors share."""
        return manifests(spark, self.folder)

    def submit(self, task: str, work: Callable[[str], dict], **known: Any) -> dict:
        """Runs the work with the job's folder; a failure is recorded with its manifest, then raised again."""
        record = self.create(task, **known)
        folder = record["output_dir"]
        os.makedirs(folder, exist_ok=True)
        self.update(record["job_id"], status="running")
        try:
            manifest = work(folder)
        except Exception as error:
            manifest = build_manifest(task, folder, {}, {}, record["parameters"], status="failed", errors=[str(error)])
            path = write_manifest(manifest)
            self.update(record["job_id"], status="failed", errors=[str(error)], manifest_path=path)
            raise
        path = write_manifest(manifest)
        return self.update(record["job_id"], status="success", manifest_path=path, outputs=manifest["outputs"], statistics=manifest["statistics"], quality_flags=manifest["quality_flags"])


def _conclusion(task: str, status: str, flags: list[dict]) -> str:
    if status == "failed":
        return f"{task} failed."
    for severity in ("error", "warning"):
        if n := sum(f.get("severity") == severity for f in flags):
            return f"{task} completed with {n} {severity} quality flag(s)."
    return f"{task} completed successfully."


def input_files(inputs: dict[str, Any]) -> list[str]:
    """Paths among the inputs; descriptions of scenes are none."""
    out: list[str] = []
    for value in inputs.values():
        out += [value] if isinstance(value, str) else [str(v) for v in value] if isinstance(value, list) else []
    return out


def build_manifest(task: str, folder: str, inputs: dict, outputs: dict, parameters: dict, statistics: dict | None = None, flags: list | None = None, model: dict | None = None, status: str = "success", metrics: dict | None = None, conclusion: str | None = None, errors: list | None = None) -> dict:
    model, flags, statistics = model or {"id": "fake", "backend": "fake"}, flags or [], statistics or {}
    return {
        "schema_version": "0.1", "job_id": os.path.basename(folder), "task": task, "status": status, "model_id": model.get("id", "unknown"), "input_files": input_files(inputs), "created_at": now(), "parameters": parameters,
        "outputs": {str(k): str(v) for k, v in outputs.items()}, "statistics": statistics, "metrics": metrics or {}, "quality_flags": flags, "conclusion": conclusion or _conclusion(task, status, flags), "errors": errors or [],
        "inputs": inputs, "model": model, "stats": statistics, "manifest_path": os.path.join(folder, "manifest.json"),
    }


def write_manifest(manifest: dict) -> str:
    os.makedirs(os.path.dirname(manifest["manifest_path"]), exist_ok=True)
    with open(manifest["manifest_path"], "w", encoding="utf-8") as file:
        json.dump(manifest, file, indent=2, ensure_ascii=False, default=plain)
    return manifest["manifest_path"]
