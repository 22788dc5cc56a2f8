"""Scenes in NPZ containers: members `data` (band, row, column) and `profile` (JSON).

A scan reads strips of rows. A member that is stored plainly is read where the strip lies. A deflated one is inflated as a stream, of
which no more than a strip is held: from the last restart point before the strip, which containers written here have at every strip, or
from the start of the member in containers of other programs; as that costs what lies before, these are dealt to at most STREAMS tasks, each
of which goes through a run of strips once for each band. A member whose columns come first is decoded as a whole.
"""

from __future__ import annotations

import io
import json
import os
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.affine import DEFAULT_CRS, DEFAULT_TRANSFORM
from . import pieces

STRIP, STREAMS = 512, 8
#: Bytes that are inflated at a time.
CHUNK = 1 << 20


def _member(path: str, name: str) -> tuple[int, int, bool]:
    """Where a member's bytes are in the file, how many, and whether they are deflated."""
    with zipfile.ZipFile(path) as container:
        info = container.getinfo(name)
    if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError("a member is neither stored nor deflated")
    with open(path, "rb") as file:
        file.seek(info.header_offset)
        names, extra = struct.unpack("<HH", file.read(30)[26:30])
    return info.header_offset + 30 + names + extra, info.compress_size, info.compress_type == zipfile.ZIP_DEFLATED


def describe(path: str) -> dict:
    """What the container says of its scene, with defaults of the georeference; no sample is decoded."""
    with zipfile.ZipFile(path) as container:
        with container.open("data.npy") as file:
            version = np.lib.format.read_magic(file)
            shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
            head = file.tell()
        named = "profile.npy" in container.namelist()
    profile = {}
    if named:
        with np.load(path, allow_pickle=False) as found:
            profile = json.loads(str(found["profile"]))
    if len(shape) == 2:
        shape = (1, *shape)
    if len(shape) != 3:
        raise ValueError("a scene has two or three dimensions")
    at, size, deflated = _member(path, "data.npy")
    restarts = profile.get("restarts") if deflated else None
    return {
        "path": path, "width": shape[2], "height": shape[1], "count": shape[0], "dtype": str(dtype.newbyteorder("=")), "crs": profile.get("crs"),
        "transform": tuple(profile.get("transform") or DEFAULT_TRANSFORM)[:6], "nodata": profile.get("nodata"), "driver": "NPZ", "fallback_container": True,
        "order": dtype.str[0].replace("|", "="), "at": at, "size": size, "deflated": deflated, "head": head, "by_column": by_column, "restarts": restarts, "high": min(STRIP, max(1, shape[1])), "wide": max(1, shape[2]),
    } | ({"tasks": STREAMS} if deflated and not restarts else {})


class _Stream:
    """Bytes of the member from a place on; going forward costs what is passed, going back starts anew."""

    def __init__(self, file, info: dict):
        self.file, self.info = file, info
        self.start(0)

    def start(self, place: int) -> None:
        """From the last restart point at or before a place."""
        points = self.info["restarts"] or [[0, 0]]
        raw, packed = max(p for p in points if p[0] <= place)
        self.place, self.next, self.left = raw, self.info["at"] + packed, self.info["size"] - packed
        self.inflate, self.held = zlib.decompressobj(-15), b""

    def read(self, place: int, size: int) -> bytes:
        points = self.info["restarts"] or ()
        if place < self.place or any(self.place + (1 << 16) < p[0] <= place for p in points):
            self.start(place)
        out = bytearray()
        while len(out) < size:
            if not self.held:
                packed = self.inflate.unconsumed_tail
                if not packed:
                    packed = os.pread(self.file.fileno(), min(CHUNK, self.left), self.next)
                    self.next, self.left = self.next + len(packed), self.left - len(packed)
                self.held = self.inflate.decompress(packed, CHUNK)
                if not self.held and not packed:
                    raise ValueError("the container ends early")
                continue
            skip = min(len(self.held), max(0, place - self.place))
            take = self.held[skip : skip + size - len(out)] if self.place + skip >= place else b""
            out += take
            self.place += skip + len(take)
            self.held = self.held[skip + len(take) :]
        return bytes(out)


class Blocks:
    """Strips of an open container."""

    def __init__(self, info: dict):
        self.info = info
        self.file = open(info["path"], "rb")  # noqa: SIM115  closed by close()
        self.streams: dict[int, _Stream] = {}

    def close(self) -> None:
        self.file.close()

    def _bytes(self, band: int, place: int, size: int) -> bytes:
        if not self.info["deflated"]:
            return os.pread(self.file.fileno(), size, self.info["at"] + place)
        if band not in self.streams:
            self.streams[band] = _Stream(self.file, self.info)
        return self.streams[band].read(place, size)

    def read(self, down: int, across: int, bands: list[int]) -> np.ndarray:
        """(band, row, column) of the bands, from 0, of a strip."""
        info = self.info
        sample = np.dtype(info["dtype"]).newbyteorder(info["order"])
        top = down * info["high"]
        rows, width = min(info["high"], info["height"] - top), info["width"]
        if info["by_column"]:
            with np.load(info["path"], allow_pickle=False) as found:
                data = found["data"]
            return (data[None] if data.ndim == 2 else data)[bands, top : top + rows]
        line = width * sample.itemsize
        parts = [np.frombuffer(self._bytes(b, info["head"] + (b * info["height"] + top) * line, rows * line), sample).reshape(rows, width) for b in bands]
        return np.stack(parts) if parts else np.zeros((0, rows, width))


def read_scene(spark: SparkSession, path: str) -> DataFrame:
    """y, x and b1 to b<count>; integer samples as longs, others as doubles."""
    from .scene_source import read

    return read(spark, path)


def write_scene(pixels: DataFrame, path: str, width: int, height: int, dtype: str, crs: str | None = DEFAULT_CRS, transform: tuple | None = None, nodata: float | None = None, strip: int = STRIP) -> None:
    """Bands in order of the columns after y and x; pixels that are not there, and nulls, are nodata or 0. Tasks deflate strips of bands; their places are restart points."""
    names = [c for c in pixels.columns if c not in ("y", "x")]
    sample = np.dtype(dtype).newbyteorder("<")
    count = -(-height // strip)

    def make(number: int, image: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        for band, plane in enumerate(image):
            raw = plane.tobytes()
            yield band * count + number, pieces.deflated(raw), raw

    def frame(file: BinaryIO, found: list[pieces.Piece]) -> list[int]:
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": np.lib.format.dtype_to_descr(sample), "fortran_order": False, "shape": (len(names), height, width)})
        raw = head.getvalue()
        first = pieces.deflated(raw)
        member = zipfile.ZipInfo("data.npy")
        member.header_offset = 0
        member.compress_type, member.file_size, member.CRC = zipfile.ZIP_DEFLATED, len(raw) + sum(p.raw for p in found), zlib.crc32(raw)
        member.compress_size = len(first) + sum(p.size for p in found) + len(pieces.END)
        restarts, at, place = [[0, 0]], len(first), len(raw)
        for p in found:
            member.CRC = pieces.joined_crc(member.CRC, p.crc, p.raw)
            restarts.append([place, at])
            at, place = at + p.size, place + p.raw
        start = len(member.FileHeader(zip64=True))
        file.write(member.FileHeader(zip64=True) + first)
        file.seek(start + at)
        file.write(pieces.END)
        profile = {"driver": "NPZ", "height": height, "width": width, "count": len(names), "dtype": dtype, "crs": crs, "transform": list(transform or DEFAULT_TRANSFORM), "nodata": nodata, "restarts": restarts}
        container = zipfile.ZipFile(file, "w")
        container.filelist.append(member)
        container.NameToInfo[member.filename] = member
        container.start_dir = file.tell()
        text = io.BytesIO()
        np.save(text, np.array(json.dumps(profile)))
        container.writestr("profile.npy", text.getvalue())
        container.close()
        return [start + packed for _, packed in restarts[1:]]

    pieces.write(path, lambda folder: pieces.strips(pixels, names, width, height, strip, sample, 0 if nodata is None else nodata, make, folder), frame, pixels)
