"""Vector features as GeoJSON: columns for lines of it, a writer of collections, a reader of both envelopes.

A collection is one JSON value, so where a feature begins depends on all that stands before it. The reader still goes by ranges of
bytes: first every range tells its quotes, and its brackets for the case that it begins outside a string and that it begins in one; sums of
these over the ranges before say how each one begins. Then ranges find the features that begin in them,
objects of an array that belongs to the outermost object, and read each to its end, which may lie in later ranges. Executors must see the
file's folder.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces

#: Bytes of a range.
RANGE = 8 << 20
QUOTE, ESCAPE = 0x22, 0x5C
#: What a byte does to the depth, outside strings.
DEPTH = np.zeros(256, np.int8)
DEPTH[[0x7B, 0x5B]], DEPTH[[0x7D, 0x5D]] = 1, -1


def feature_json(ring: Column, properties: Column) -> Column:
    """One GeoJSON feature of a polygon's ring (array of struct<x, y>) as text."""
    points = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def write_lines(features: DataFrame, path: str, column: str = "feature") -> None:
    """Newline-delimited features, in as many files as the table has partitions."""
    features.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_collection(features: DataFrame, path: str, crs: str | None = None, column: str = "feature") -> None:
    """One collection file, for other programs: tasks write their features, in the table's order. No features give an empty collection."""

    def frame(file: BinaryIO, found: list[pieces.Piece]) -> list[int]:
        file.write(b'{"type": "FeatureCollection", "features": [')
        places = []
        for i, p in enumerate(found):
            file.write(b",\n" if i else b"\n")
            places.append(file.tell())
            file.seek(p.size, os.SEEK_CUR)
        file.write(b"]" + (b', "crs": ' + json.dumps({"type": "name", "properties": {"name": crs}}).encode() if crs else b"") + b"}\n")
        return places

    pieces.write(path, lambda folder: pieces.lines(features, column, b",\n", folder), frame, features)


def _bytes(file: int, at: int, size: int) -> np.ndarray:
    parts = []
    while size > 0 and (part := os.pread(file, size, at)):
        parts.append(part)
        at, size = at + len(part), size - len(part)
    return np.frombuffer(b"".join(parts), np.uint8)


def _quotes(file: int, at: int, data: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that no backslash escapes, also one before the range."""
    before, size = 0, 64
    while at and before < at:  # backslashes that end right before the range
        head = _bytes(file, max(0, at - size), min(size, at))
        other = np.flatnonzero(head != ESCAPE)
        before = len(head) - 1 - int(other[-1]) if len(other) else len(head)
        if len(other) or size >= at:
            break
        size *= 4
    out = data == QUOTE
    found = np.flatnonzero(out)
    plain = np.flatnonzero(data != ESCAPE)
    last = np.searchsorted(plain, found) - 1  # the last other byte before each
    run = np.where(last >= 0, found - 1 - (plain[last] if len(plain) else 0), found + before)
    out[found[run % 2 == 1]] = False
    return out


def _inside(quotes: np.ndarray, begins_inside: bool) -> np.ndarray:
    """Which bytes stand in strings, closing quotes left out."""
    return (np.cumsum(quotes) + begins_inside) % 2 == 1


def _ranges(path: str, spark: SparkSession, size: int) -> tuple[DataFrame, int]:
    length = os.path.getsize(path)
    n = max(1, -(-length // size))
    return spark.range(0, n, 1, min(n, 4096)), length


def split_features(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """value: the text of every object of the array `features` of the outermost object, or else of `records`, by ranges of so many bytes."""
    starts, length = _ranges(path, spark, size)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = os.open(path, os.O_RDONLY)
        try:
            for batch in batches:
                out = []
                for i in batch.column(0).to_pylist():
                    data = _bytes(file, i * size, min(size, length - i * size))
                    quotes = _quotes(file, i * size, data)
                    step = DEPTH[data]
                    within = _inside(quotes, False)
                    out.append((i, int(quotes.sum()), int(step[~within].sum(dtype=np.int64)), int(step[within].sum(dtype=np.int64))))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4, ["i", "quotes", "outside", "inside"])
        finally:
            os.close(file)

    told = sorted(starts.mapInArrow(summed, "i long, quotes long, outside long, inside long").collect())  # a row per range
    state, within, depth = [], False, 0
    for _, quotes, outside, inside in told:
        state.append((within, depth))
        depth += inside if within else outside
        within ^= bool(quotes % 2)

    def deep(file: int, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of a range, whether each counts, and the depth after it."""
        data = _bytes(file, i * size, min(size, length - i * size))
        counts = ~_inside(_quotes(file, i * size, data), state[i][0])
        return data, counts, state[i][1] + np.cumsum(DEPTH[data] * counts, dtype=np.int64)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where arrays of the outermost object begin and end."""
        file = os.open(path, os.O_RDONLY)
        try:
            for batch in batches:
                out = []
                for i in batch.column(0).to_pylist():
                    data, counts, depth = deep(file, i)
                    opens = np.flatnonzero(counts & (data == 0x5B) & (depth == 2))
                    ends = np.flatnonzero(counts & (data == 0x5D) & (depth == 1))
                    out += [(i * size + k, 1, _name(file, i * size + k)) for k in opens.tolist()] + [(i * size + k, 0, "") for k in ends.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["at", "opens", "name"])
        finally:
            os.close(file)

    # a row per member of the outermost object; an outermost array's own members have no name and are no features
    marks = sorted((r["at"], r["opens"], r["name"]) for r in starts.mapInArrow(arrays, "at long, opens long, name string").filter("opens = 0 or name in ('features', 'records')").collect())
    owners = []
    for (at, opens, name), (end, _, _) in zip(marks, [*marks[1:], (length, 0, "")], strict=False):
        if opens:
            owners.append((at, end, name))
    wanted = "features" if any(name == "features" for *_, name in owners) else "records"
    owners = [(at, end) for at, end, name in owners if name == wanted]

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = os.open(path, os.O_RDONLY)
        try:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    data, counts, depth = deep(file, i)
                    braces = counts & ((data == 0x7B) | (data == 0x7D))
                    begins = i * size + np.flatnonzero(braces & (data == 0x7B) & (depth == 3))
                    ends = i * size + np.flatnonzero(braces & (data == 0x7D) & (depth == 2))
                    values = []
                    for first, end in owners:
                        for at in begins[(begins > first) & (begins < end)].tolist():
                            k = int(np.searchsorted(ends, at))
                            if k < len(ends):
                                text = data[at - i * size : int(ends[k]) + 1 - i * size].tobytes()
                            else:
                                parts, j = [data[at - i * size :]], i + 1
                                while (j * size) < length:
                                    more, counted, after = deep(file, j)
                                    close = np.flatnonzero(counted & (more == 0x7D) & (after == 2))
                                    parts.append(more[: int(close[0]) + 1] if len(close) else more)
                                    if len(close):
                                        break
                                    j += 1
                                text = np.concatenate(parts).tobytes()
                            values.append(text.decode("utf-8"))
                    yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])
        finally:
            os.close(file)

    return starts.mapInArrow(cut_out, "value string") if owners else spark.createDataFrame([], "value string")


def _name(file: int, at: int) -> str:
    """The key whose value begins at a place; names of more than some 64 bytes aren't told."""
    head = _bytes(file, max(0, at - 512), min(512, at)).tobytes().rstrip()
    if not head.endswith(b":"):
        return ""
    head = head[:-1].rstrip()
    first = head.rfind(b'"', 0, len(head) - 1)
    return head[first + 1 : -1].decode("utf-8", "replace") if head.endswith(b'"') and first >= 0 else ""


def read_features(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """label, score, class_id and ring of features of a file with `features` or else `records`; no rows of another envelope."""
    point = "array<array<array<double>>>"
    feature = f"struct<geometry:struct<type:string,coordinates:{point}>,properties:struct<label:string,score:double,class_id:int>,label:string,score:double,class_id:int>"
    rows = split_features(spark, path, size).select(F.from_json("value", feature).alias("f")).select("f.*")
    ring = F.when(F.col("geometry.type") == "Polygon", F.transform(F.col("geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    pick = lambda n: F.coalesce(F.col(f"properties.{n}"), F.col(n)).alias(n)
    return rows.select(pick("label"), pick("score"), pick("class_id"), F.coalesce(ring, F.array().cast("array<struct<x:double,y:double>>")).alias("ring"))
