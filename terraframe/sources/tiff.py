"""GeoTIFF and BigTIFF without other libraries: strips or tiles, plain, deflate, LZW or PackBits, with or without
differencing, planar or interleaved, little or big endian.

Reading opens strips or tiles one by one; where each lies is looked up in the file when it is opened, so a file's tables are
never held or sent. Writing puts strips of rows to known places of a hidden file beside the one wanted, which takes its name
when all tasks are done: a task that runs again writes the same bytes, and a job that fails leaves nothing. Executors must see the
file's folder.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

# Fixed values of TIFF 6.0, BigTIFF and GeoTIFF: sizes and codes of field types, tags, sample formats.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
SCALE, TIEPOINT, MATRIX, GEOKEYS, NODATA = 33550, 33922, 34264, 34735, 42113
PROJECTED, GEOGRAPHIC = 3072, 2048
FORMATS = {"u": 1, "i": 2, "f": 3}
CLASSIC, BIG = 42, 43
#: Bytes of all bands of a strip that is written, and its rows at most.
STRIP_BYTES, STRIP = 8 << 20, 256
#: A file of more bytes is written as BigTIFF.
CLASSIC_LIMIT = (1 << 32) - (1 << 20)
#: Fields with more values are looked up value by value.
SHORT = 64


def _fields(path: str) -> tuple[dict[int, tuple[int, int, int]], str]:
    """Tag -> (type, how many values, where the first is) of the first image, and the byte order."""
    with open(path, "rb") as file:
        head = file.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(order + "H", head[2:4])[0] if order and len(head) >= 8 else 0
        if version not in (CLASSIC, BIG) or (version == BIG and struct.unpack(order + "HH", head[4:8]) != (8, 0)):
            raise ValueError("not a TIFF file")
        first, count, entry, inline = ("I", "H", "HHI", 4) if version == CLASSIC else ("Q", "Q", "HHQ", 8)
        at = struct.unpack(order + first, head[4:8] if version == CLASSIC else head[8:16])[0]
        file.seek(at)
        (n,) = struct.unpack(order + count, file.read(struct.calcsize(count)))
        width = struct.calcsize("<" + entry) + inline
        raw, at = file.read(width * n), at + struct.calcsize(count)
        out = {}
        for i in range(n):
            tag, kind, values = struct.unpack(order + entry, raw[width * i : width * (i + 1) - inline])
            where = at + width * (i + 1) - inline
            if SIZES.get(kind, 1) * values > inline:
                (where,) = struct.unpack(order + first, raw[width * (i + 1) - inline : width * (i + 1)])
            out[tag] = (kind, values, where)
    return out, order


def _values(file, field: tuple[int, int, int], order: str, at: int = 0, n: int | None = None) -> tuple:
    """Values of a field, from the `at`-th on."""
    kind, count, where = field
    size, n = SIZES.get(kind, 1), count if n is None else n
    raw = os.pread(file.fileno(), size * n, where + size * at)
    return (raw.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(f"{order}{n}{CODES[kind]}", raw) if kind in CODES else ()


def describe(path: str) -> dict:
    found, order = _fields(path)
    with open(path, "rb") as file:
        fields = {tag: _values(file, field, order) for tag, field in found.items() if field[1] <= SHORT or tag in (GEOKEYS, NODATA)}
    if fields.get(COMPRESSION, (1,))[0] not in DECODERS:
        raise ValueError(f"TIFF compression {fields[COMPRESSION][0]} is not read")
    tiled = TILE_OFFSETS in found
    high = fields[TILE_HEIGHT][0] if tiled else min(fields.get(ROWS, fields[HEIGHT])[0], fields[HEIGHT][0])
    bits = fields.get(BITS, (1,))[0] if BITS not in found or BITS in fields else 8
    if BITS in found and BITS not in fields:
        with open(path, "rb") as file:
            bits = _values(file, found[BITS], order, 0, 1)[0]
    sample = fields.get(FORMAT, (1,))[0]
    if FORMAT in found and FORMAT not in fields:
        with open(path, "rb") as file:
            sample = _values(file, found[FORMAT], order, 0, 1)[0]
    kind = {1: "uint", 2: "int", 3: "float"}[sample]
    transform = None
    if MATRIX in fields:
        m = fields[MATRIX]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif SCALE in fields and TIEPOINT in fields:
        (sx, sy, *_), (i, j, _, x, y, *_) = fields[SCALE], fields[TIEPOINT]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    keys = fields.get(GEOKEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    code = codes.get(PROJECTED) or codes.get(GEOGRAPHIC)
    nodata = fields.get(NODATA, (None,))[0]
    return {
        "path": path, "width": fields[WIDTH][0], "height": fields[HEIGHT][0], "count": fields.get(SAMPLES, (1,))[0], "dtype": f"{kind}{bits}", "crs": f"EPSG:{code}" if code else None,
        "transform": transform, "nodata": float(nodata) if nodata not in (None, "") else None, "driver": "GTiff", "fallback_container": False, "order": order,
        "offsets": found[TILE_OFFSETS if tiled else OFFSETS], "sizes": found.get(TILE_COUNTS if tiled else COUNTS), "tiled": tiled, "high": high, "wide": fields[TILE_WIDTH][0] if tiled else fields[WIDTH][0],
        "planar": fields.get(PLANAR, (1,))[0] == 2, "compression": fields.get(COMPRESSION, (1,))[0], "predictor": fields.get(PREDICTOR, (1,))[0],
    }


def _lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears the table, 257 ends."""
    out, table, before = [], [], b""
    bits = held = at = 0
    width = 9
    while True:
        while held < width:
            if at == len(raw):
                return b"".join(out)
            bits, held, at = (bits << 8 | raw[at]) & 0xFFFFFF, held + 8, at + 1
        code = bits >> (held - width) & ((1 << width) - 1)
        held -= width
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, before, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        out.append(entry)
        if before:
            table.append(before + entry[:1])
        before = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def _packbits(raw: bytes) -> bytes:
    out, at = [], 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out.append(raw[at + 1 : at + 2 + n])
            at += 2 + n
        elif n > 128:
            out.append(raw[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
    return b"".join(out)


DECODERS = {PLAIN: bytes, LZW: _lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: _packbits}


def _samples(raw: bytes, info: dict, rows: int, bands: int) -> np.ndarray:
    """(row, column, band) of one strip or tile."""
    dtype = np.dtype(info["dtype"]).newbyteorder(info["order"])
    data = np.frombuffer(DECODERS[info["compression"]](raw), np.uint8)[: rows * info["wide"] * bands * dtype.itemsize]
    if info["predictor"] == 3:  # bytes of a row's values by significance, each after the one before
        planes = np.cumsum(data.reshape(rows, dtype.itemsize * info["wide"], bands), axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, info["wide"] * bands)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, info["wide"], bands)
    data = data.view(dtype).reshape(rows, info["wide"], bands)
    if info["predictor"] == 2:
        data = np.cumsum(data, axis=1, dtype=dtype.newbyteorder("="))
    return data


class Blocks:
    """Strips or tiles of an open file, read one by one."""

    def __init__(self, info: dict):
        self.info = info
        self.across = -(-info["width"] // info["wide"])
        self.parts = self.across * -(-info["height"] // info["high"])
        self.file = open(info["path"], "rb")  # noqa: SIM115  closed by close()

    def close(self) -> None:
        self.file.close()

    def _stored(self, number: int, rows: int, bands: int) -> np.ndarray:
        info = self.info
        (at,) = _values(self.file, info["offsets"], info["order"], number, 1)
        size = _values(self.file, info["sizes"], info["order"], number, 1)[0] if info["sizes"] else rows * info["wide"] * bands * np.dtype(info["dtype"]).itemsize
        return _samples(os.pread(self.file.fileno(), size, at), info, rows, bands)

    def read(self, down: int, across: int, bands: list[int]) -> np.ndarray:
        """(band, row, column) of the bands, from 0, of the part that is so many parts down and across; a planar file's other bands aren't read."""
        info = self.info
        number = down * self.across + across
        top, left = down * info["high"], across * info["wide"]
        rows = info["high"] if info["tiled"] else min(info["high"], info["height"] - top)
        if info["planar"]:
            data = np.stack([self._stored(b * self.parts + number, rows, 1)[:, :, 0] for b in bands]) if bands else np.zeros((0, rows, info["wide"]))
        else:
            data = self._stored(number, rows, info["count"]).transpose(2, 0, 1)[bands]
        return data[:, : info["height"] - top, : info["width"] - left]


def read_scene(spark: SparkSession, path: str) -> DataFrame:
    """y, x and b1 to b<count>; integer samples as longs, others as doubles."""
    from .scene_source import read

    return read(spark, path)


class Layout:
    """Places of a file that is written: planar strips one after another, then the fields."""

    def __init__(self, width: int, height: int, bands: int, dtype: str, crs: str | None, transform: tuple | None, nodata: float | None, big: bool | None = None):
        self.width, self.height, self.bands, self.nodata = width, height, bands, nodata
        self.sample = np.dtype(dtype).newbyteorder("<")
        self.line = width * self.sample.itemsize
        self.rows = max(1, min(STRIP, height, STRIP_BYTES // max(1, self.line * bands)))
        self.strips = -(-height // self.rows)
        size = bands * height * self.line + 16 * bands * self.strips
        self.big = size >= CLASSIC_LIMIT if big is None else big
        self.start = 16 if self.big else 8
        self.crs, self.transform = crs, transform

    def place(self, band: int, y: int) -> int:
        return self.start + (band * self.height + y) * self.line

    def fields(self) -> bytes:
        """The directory and what its entries point to, as it stands after the pixels."""
        n, bits, word = self.bands, self.sample.itemsize * 8, "Q" if self.big else "I"
        first = np.arange(self.strips, dtype=np.int64) * self.rows
        offsets = (self.start + (np.arange(n, dtype=np.int64)[:, None] * self.height + first) * self.line).ravel()
        counts = np.tile(np.minimum(self.rows, self.height - first) * self.line, n)
        table: dict[int, tuple[str, object]] = {
            WIDTH: ("I", [self.width]), HEIGHT: ("I", [self.height]), BITS: ("H", [bits] * n), COMPRESSION: ("H", [1]), PHOTOMETRIC: ("H", [1]), OFFSETS: (word, offsets), SAMPLES: ("H", [n]), ROWS: ("I", [self.rows]),
            COUNTS: (word, counts), PLANAR: ("H", [2]), FORMAT: ("H", [FORMATS[self.sample.kind]] * n),
        }
        if self.transform is not None:
            a, b, c, d, e, f = tuple(self.transform)[:6]
            table[MATRIX] = ("d", [a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1])
        if self.crs and self.crs.upper().startswith("EPSG:"):
            code = int(self.crs[5:])
            geographic = 4000 <= code < 5000
            table[GEOKEYS] = ("H", [1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, code])
        if self.nodata is not None:
            table[NODATA] = ("s", f"{self.nodata:g}".encode() + b"\0")
        kinds = {"H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}
        count, entry, inline, pointer = ("<Q", "<HHQ", 8, "<Q") if self.big else ("<H", "<HHI", 4, "<I")
        at = self.place(n, 0)
        extra_at = at + struct.calcsize(count) + (struct.calcsize(entry) + inline) * len(table) + struct.calcsize(pointer)
        entries, extra = b"", b""
        for tag in sorted(table):
            code, values = table[tag]
            raw = values if code == "s" else np.asarray(values).astype("<" + {"H": "u2", "I": "u4", "Q": "u8", "d": "f8"}[code]).tobytes()
            entries += struct.pack(entry, tag, kinds[code], len(values))
            if len(raw) > inline:
                entries += struct.pack(pointer, extra_at + len(extra))
                extra += raw + b"\0" * (-len(raw) % 8)
            else:
                entries += raw.ljust(inline, b"\0")
        return struct.pack(count, len(table)) + entries + bytes(struct.calcsize(pointer)) + extra

    def head(self) -> bytes:
        at = self.place(self.bands, 0)
        return b"II" + (struct.pack("<HHHQ", BIG, 8, 0, at) if self.big else struct.pack("<HI", CLASSIC, at))


class SceneWriter(DataSourceArrowWriter):
    """Writes whole strips to a hidden file, which is renamed once all tasks are done.

    Rows have `__strip`, y, x and the bands, and come sorted; a row without a place only says that its strip is to be filled with nodata.
    """

    def __init__(self, path: str, layout: Layout):
        self.path, self.layout = path, layout
        folder, name = os.path.split(os.path.abspath(path))
        self.hidden = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        with open(self.hidden, "wb") as file:
            file.write(layout.head())
            file.seek(layout.place(layout.bands, 0))
            file.write(layout.fields())

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        own = self.layout
        number, strip = -1, np.empty(0)
        file = os.open(self.hidden, os.O_WRONLY)

        def put() -> None:
            for band in range(own.bands) if number >= 0 else ():
                raw, at = strip[band].tobytes(), own.place(band, number * own.rows)
                while raw:
                    done = os.pwrite(file, raw, at)
                    raw, at = raw[done:], at + done

        try:
            for batch in iterator:
                if not len(batch):
                    continue
                which, y = batch.column(0).to_numpy(), batch.column(1)
                there = np.asarray(y.is_valid())
                edges = np.flatnonzero(np.r_[True, which[1:] != which[:-1], True])
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if which[i] != number:
                        put()
                        number = int(which[i])
                        rows = min(own.rows, own.height - number * own.rows)
                        strip = np.full((own.bands, rows, own.width), own.nodata or 0, own.sample)
                    use = i + np.flatnonzero(there[i:j])
                    at = pa.array(use)
                    down, across = y.take(at).to_numpy() - number * own.rows, batch.column(2).take(at).to_numpy()
                    for band in range(own.bands):
                        values = batch.column(3 + band).take(at)
                        if values.null_count:
                            values = values.fill_null(own.nodata or 0)
                        strip[band, down, across] = values.to_numpy(zero_copy_only=False).astype(own.sample)
            put()
            os.fsync(file)
        finally:
            os.close(file)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        os.replace(self.hidden, self.path)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.hidden):
            os.remove(self.hidden)


def write_scene(pixels: DataFrame, path: str, width: int, height: int, dtype: str, crs: str | None = None, transform: tuple | None = None, nodata: float | None = None, big: bool | None = None) -> None:
    """Bands in order of the columns after y and x, each in strips of its own; pixels that are not there, and nulls, are nodata or 0.

    A file that would pass 4 GB, or any with `big`, is BigTIFF. Pixels outside the scene raise. Strips without pixels aren't written where
    nodata is 0 or none: they are holes, which read as zeros.
    """
    from .scene_source import save

    names = [c for c in pixels.columns if c not in ("y", "x")]
    layout = Layout(width, height, len(names), dtype, crs, transform, nodata, big)
    place = [F.col(c).cast("long").alias(c) for c in ("y", "x")]
    inside = (F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)
    checked = F.when(inside, F.floor(F.col("y") / layout.rows)).otherwise(F.raise_error(F.lit("a pixel lies outside the scene"))).cast("long")
    rows = pixels.select(*place, *names).select(checked.alias("__strip"), "y", "x", *names)
    if nodata:
        spark = pixels.sparkSession
        empty = spark.range(layout.strips).select(F.col("id").alias("__strip"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("y", "x", *names)])
        rows = rows.union(empty)
    save(rows.repartitionByRange("__strip").sortWithinPartitions("__strip", "y", "x"), path, layout)
