"""Files made of pieces by tasks, compressed strips or lines of text, and put together without passing through the driver.

A strip of rows is an image in one task, which deflates it up to a full flush: such pieces, one after another, are one
deflate stream, and each can be inflated by itself. Tasks stage pieces under names of their own in a hidden folder beside the file wanted;
the driver learns their sizes and checksums (a row per piece), knows every piece's place by them, and a second
job copies pieces there. The file takes its name when all is in place. Executors must see the folder. A task
that runs again stages anew, what only a lost attempt staged is never used, and a job that fails leaves no file.
"""

from __future__ import annotations

import os
import shutil
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGED = "`order` long, name string, size long, stored_crc long, raw long, crc long, adler long"
#: Ends a stream of pieces: a last block of no bytes.
END = b"\x03\x00"
ADLER = 65521
# Fixed value: the polynomial of CRC-32, lowest power first.
CRC_POLYNOMIAL = 0xEDB88320


class Piece(NamedTuple):
    """order, where it is staged, size and checksum of that, and size and checksums of what it holds."""

    order: int
    name: str
    size: int
    stored_crc: int
    raw: int
    crc: int
    adler: int


def deflated(raw: bytes, more: bool = True) -> bytes:
    """A part of a stream; with `more`, others may follow."""
    packer = zlib.compressobj(wbits=-15)
    return packer.compress(raw) + packer.flush(zlib.Z_FULL_FLUSH if more else zlib.Z_FINISH)


def joined_adler(first: int, second: int, size: int) -> int:
    """Adler-32 of bytes whose parts have these sums, the second of so many bytes."""
    a, b = first & 0xFFFF, first >> 16
    c, d = second & 0xFFFF, second >> 16
    return (b + d + size * (a - 1)) % ADLER << 16 | (a + c - 1) % ADLER


def _product(a: int, b: int) -> int:
    """Of polynomials over two elements, modulo CRC-32's; bit 31 is the power 0."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """CRC-32 of bytes whose parts have these sums: the first, times x for each bit that follows, and the second."""
    power, square, n = 1 << 31, 1 << 30, 8 * size
    while n:
        if n & 1:
            power = _product(power, square)
        square, n = _product(square, square), n >> 1
    return _product(power, first) ^ second


def strips(pixels: DataFrame, names: list[str], width: int, height: int, rows: int, dtype: np.dtype, empty: float, make: Callable[[int, np.ndarray], Iterator[tuple[int, bytes, bytes]]], folder: str) -> list[Piece]:
    """Stages what `make` gives of each strip (number, (band, row, column)): order, bytes as they are stored, and raw bytes for the checksums.

    Pixels that are not there, and nulls, are `empty`; those outside the scene raise.
    """
    inside = (F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)
    number = F.when(inside, F.floor(F.col("y") / rows)).otherwise(F.raise_error(F.lit("a pixel lies outside the scene"))).cast("long")
    there = pixels.select(number.alias("strip"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *names)
    every = pixels.sparkSession.range(-(-height // rows)).select(F.col("id").alias("strip"), *[F.lit(None).cast(there.schema[c].dataType).alias(c) for c in ("y", "x", *names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, image = -1, np.empty(0)

        def staged() -> list[Piece]:
            out = []
            for order, stored, raw in make(at, image) if at >= 0 else ():
                name = f"{order}-{uuid.uuid4().hex}"
                with open(os.path.join(folder, name), "wb") as file:
                    file.write(stored)
                out.append(Piece(order, name, len(stored), zlib.crc32(stored), len(raw), zlib.crc32(raw), zlib.adler32(raw)))
            return out

        def told(found: list[Piece]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], list(Piece._fields))

        for batch in batches:
            if not len(batch):
                continue
            which, place = batch.column(0).to_numpy(), np.asarray(batch.column(1).is_valid())
            edges = np.flatnonzero(np.r_[True, which[1:] != which[:-1], True])
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if which[i] != at:
                    if found := staged():
                        yield told(found)
                    at = int(which[i])
                    image = np.full((len(names), min(rows, height - at * rows), width), empty, dtype)
                use = pa.array(i + np.flatnonzero(place[i:j]))
                y, x = (batch.column(c).take(use).to_numpy() for c in (1, 2))
                for band in range(len(names)):
                    values = batch.column(3 + band).take(use)
                    image[band, y - at * rows, x] = (values.fill_null(empty) if values.null_count else values).to_numpy(zero_copy_only=False).astype(dtype)
        if found := staged():
            yield told(found)

    dealt = there.union(every).repartitionByRange("strip").sortWithinPartitions("strip")
    made = dealt.mapInArrow(run, STAGED).collect()
    return sorted(Piece(*r) for r in made)


def lines(rows: DataFrame, column: str, between: bytes, folder: str) -> list[Piece]:
    """Stages the texts of each partition, in its order, with bytes between them; pieces are in order of partitions, and those without rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size = uuid.uuid4().hex, 0
        with open(os.path.join(folder, name), "wb") as file:
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    size += file.write((between if size else b"") + (text or "").encode())
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (TaskContext.get().partitionId(), name, size, 0, size, 0, 0)], list(Piece._fields))

    return sorted(Piece(*r) for r in rows.select(column).mapInArrow(run, STAGED).collect())


def write(path: str, stage: Callable[[str], list[Piece]], frame: Callable[[BinaryIO, list[Piece]], list[int]], pixels: DataFrame) -> None:
    """`stage` gives the pieces, `frame` writes what stands around them and tells each one's place; the pieces are copied there by tasks."""
    parent, name = os.path.split(os.path.abspath(path))
    folder = os.path.join(parent, f".{name}.{uuid.uuid4().hex}")
    hidden = f"{folder}.file"
    os.mkdir(folder)
    try:
        found = stage(folder)
        with open(hidden, "w+b") as file:
            places = frame(file, found)

        def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = os.open(hidden, os.O_WRONLY)
            try:
                for batch in batches:
                    for source, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        with open(os.path.join(folder, source), "rb") as file:
                            while part := file.read(1 << 20):
                                at += os.pwrite(out, part, at)
                os.fsync(out)
            finally:
                os.close(out)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32())], ["done"])

        if found:
            session = pixels.sparkSession
            moves = session.createDataFrame([(p.name, at) for p, at in zip(found, places, strict=True)], "name string, at long")
            moves.repartition(min(len(found), session.sparkContext.defaultParallelism)).mapInArrow(copy, "done int").count()
        os.replace(hidden, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        if os.path.exists(hidden):
            os.remove(hidden)
