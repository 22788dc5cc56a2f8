"""Media columns: baseline JPEG written and parsed in numpy, thumbnails from DC terms alone.

`thumbnails` reads any baseline JPEG (8 bits, Huffman, interleaved scan, any sampling, with or
without restart intervals): it parses the markers, decodes the scan and keeps the DC term of
every luminance block, a thumbnail of an eighth of the size. Restart intervals are decoded side by
side, a block of each at a time, so the work per byte is a few numpy operations.

`pack` stores bytes losslessly in that form: a sample of the thumbnail is a byte, that is, an 8x8
block of one grey whose DC term, quantised by 8, is the byte less 128. JPEG is lossy in general, but
not for such blocks.

Defined results: a null text is an empty one; payloads of any length are stored, in several frames
back to back where a frame's sides would pass 65535 pixels; equal payloads give equal bytes; a
stream that is cut short or not baseline raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import bounded, pieces, text_buffers
from .tables import map_arrow

#: Payloads are padded to a positive multiple of this.
UNIT = 576
PAD = 255
#: Blocks to a row: of payloads of up to NARROW * 8191 bytes, and of longer ones.
NARROW, WIDE, MOST_ROWS = 24, 576, 8190
#: Blocks to a restart interval.
INTERVAL = 24

# The luminance DC code lengths of ITU-T T.81, table K.3, by size category 0 to 11.
DC_BITS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_VALUES = list(range(12))
#: The AC table has one code, 0, for the end of the block.
AC_BITS = [1] + [0] * 15
AC_VALUES = [0]


def _codes(bits: list[int]) -> list[tuple[int, int]]:
    """(code, length) of each value of a Huffman table."""
    out, code = [], 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((code, length))
            code += 1
        code <<= 1
    return out


def _symbol_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and length of a block's code, by DC difference + 255: size category, magnitude, end of block."""
    value, length = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    dc = _codes(DC_BITS)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[DC_VALUES.index(size)]
        value[d + 255] = (code << size | (d if d >= 0 else d + (1 << size) - 1)) << 1
        length[d + 255] = n + size + 1
    return value, length


VALUE, LENGTH = _symbol_tables()
LONGEST = int(LENGTH.max())


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _header(columns: int, rows: int) -> bytes:
    size = (rows * 8).to_bytes(2, "big") + (columns * 8).to_bytes(2, "big")
    return b"".join([
        b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xDB, b"\0" + bytes([8] * 64)),
        _segment(0xC0, b"\x08" + size + b"\1\1\x11\0"), _segment(0xC4, b"\x00" + bytes(DC_BITS) + bytes(DC_VALUES)),
        _segment(0xC4, b"\x10" + bytes(AC_BITS) + bytes(AC_VALUES)), _segment(0xDD, INTERVAL.to_bytes(2, "big")), _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ])


def frames(n: int) -> list[tuple[int, int]]:
    """(columns, rows) of the frames that hold n bytes, n a positive multiple of UNIT."""
    if n <= NARROW * MOST_ROWS:
        return [(NARROW, n // NARROW)]
    rows = n // WIDE
    return [(WIDE, min(MOST_ROWS, rows - at)) for at in range(0, rows, MOST_ROWS)]


def _scans(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all intervals, with stuffing; the offsets of each; their count of bytes."""
    lanes = samples.reshape(-1, INTERVAL).astype(np.int16)
    diff = np.diff(lanes, axis=1, prepend=np.int16(128)) + 255
    length = np.zeros((len(lanes), INTERVAL + 1), np.int64)
    value = np.zeros((len(lanes), INTERVAL + 1), np.uint16)
    length[:, :-1], value[:, :-1] = LENGTH[diff], VALUE[diff]
    used = length.sum(axis=1)
    length[:, -1] = -used % 8
    value[:, -1] = (1 << length[:, -1]) - 1
    length, value = length.ravel(), value.ravel()
    place = np.arange(LONGEST - 1, -1, -1, dtype=np.uint16)
    bits = ((value[:, None] >> place) & 1).astype(np.uint8)
    packed = np.packbits(bits[place < length[:, None]])
    full = packed == 0xFF
    end = np.cumsum((used + 7) // 8)
    stuffed = np.concatenate([[0], np.cumsum(full)])
    out = np.insert(packed, np.flatnonzero(full) + 1, 0)
    return out, np.concatenate([[0], end + stuffed[end]])


def pack(payloads: list[bytes]) -> list[bytes]:
    """Each payload, of a positive multiple of UNIT bytes, as JPEG frames back to back."""
    if not payloads:
        return []
    data, at = _scans(np.frombuffer(b"".join(payloads), np.uint8))
    data, out, lane = data.tobytes(), [], 0
    for payload in payloads:
        parts = []
        for columns, rows in frames(len(payload)):
            n = columns * rows // INTERVAL
            edges = at[lane : lane + n + 1].tolist()
            parts.append(_header(columns, rows))
            for i in range(n):
                parts += [data[edges[i] : edges[i + 1]], bytes([0xFF, 0xD0 + i % 8]) if i < n - 1 else b"\xff\xd9"]
            lane += n
        out.append(b"".join(parts))
    return out


class Frame:
    """What the markers of one frame say, and its entropy-coded intervals."""

    def __init__(self, data: bytes, at: int):
        """Parses the frame that starts at `at`; `end` is where it ends."""
        self.quant: dict[int, int] = {}
        self.huffman: dict[tuple[int, int], np.ndarray] = {}
        self.interval, self.components = 0, []
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if len(data) < at + 4 or data[at] != 0xFF:
                raise ValueError("no marker where one is due")
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC0 or marker == 0xC1:
                self._frame(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.interval = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                self.scan = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                break
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not baseline")
        if not self.components or len(self.scan) != len(self.components):
            raise ValueError("components are not interleaved in one scan")
        self.start = at
        across, down = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if len(self.components) == 1:
            self.components, across, down = [(self.components[0][0], 1, 1, self.components[0][3])], 1, 1
        self.mcus = -(-self.width // (8 * across)), -(-self.height // (8 * down))
        self.blocks = [i for i, c in enumerate(self.components) for _ in range(c[1] * c[2])]

    def _quantisers(self, body: bytes) -> None:
        while body:
            wide, n = body[0] >> 4, 64 * (1 + (body[0] >> 4))
            self.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
            body = body[1 + n :]

    def _frame(self, body: bytes) -> None:
        if body[0] != 8:
            raise ValueError("not 8 bits a sample")
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]

    def _huffman(self, body: bytes) -> None:
        while body:
            bits = list(body[1:17])
            values = body[17 : 17 + sum(bits)]
            # symbol and code length by the next 16 bits; length 0: no such code
            look = np.zeros(1 << 16, np.uint16)
            for (code, length), value in zip(_codes(bits), values, strict=True):
                look[code << 16 - length : code + 1 << 16 - length] = value << 8 | length
            self.huffman[body[0] >> 4, body[0] & 15] = look
            body = body[17 + sum(bits) :]

    def layout(self) -> tuple:
        """Frames of equal layouts can be decoded side by side."""
        tables = tuple((self.scan[c[0]], self.huffman[0, self.scan[c[0]][0]].tobytes(), self.huffman[1, self.scan[c[0]][1]].tobytes()) for c in self.components)
        return tuple(self.blocks), hash(tables)


def _decode(windows: np.ndarray, start: np.ndarray, end: np.ndarray, mcus: np.ndarray, frame: Frame) -> list[np.ndarray]:
    """DC terms of each interval's blocks, intervals side by side: by component an array (intervals, blocks).

    windows: at each byte the 40 bits from there on. start, end: bit positions. mcus: of each interval.
    """
    n, per = len(start), len(frame.blocks)
    most = int(mcus.max(initial=0))
    terms = [np.zeros((n, most * frame.blocks.count(c)), np.int32) for c in range(len(frame.components))]
    last = [np.zeros(n, np.int32) for _ in frame.components]
    at = start.copy()
    tables = [(frame.huffman[0, frame.scan[c[0]][0]], frame.huffman[1, frame.scan[c[0]][1]]) for c in frame.components]
    order = np.argsort(-mcus, kind="stable")
    live = np.searchsorted(-mcus[order], -np.arange(most), side="left")  # intervals of more than m MCUs come first
    filled = [0] * len(terms)

    def peek(where: np.ndarray) -> np.ndarray:
        return (windows[where >> 3] >> (8 - (where & 7)).astype(np.uint64)) & np.uint64(0xFFFFFFFF)

    for m in range(most):
        lanes = order[: live[m]]
        for b in range(per):
            c = frame.blocks[b]
            dc, ac = tables[c]
            where = at[lanes]
            v = peek(where)
            hit = dc[(v >> np.uint64(16)).astype(np.int64)].astype(np.int64)
            length, size = hit & 255, hit >> 8
            if (length == 0).any():
                raise ValueError("a code that is not in the table")
            extra = ((v >> (32 - length - size).astype(np.uint64)).astype(np.int64)) & ((1 << size) - 1)
            diff = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
            last[c][lanes] += diff.astype(np.int32)
            terms[c][lanes, filled[c]] = last[c][lanes]
            filled[c] += 1
            where += length + size
            at[lanes] = where
            todo, k = lanes, np.ones(len(lanes), np.int64)
            while len(todo):
                where = at[todo]
                hit = ac[(peek(where) >> np.uint64(16)).astype(np.int64)].astype(np.int64)
                length, symbol = hit & 255, hit >> 8
                if (length == 0).any():
                    raise ValueError("a code that is not in the table")
                at[todo] = where + length + (symbol & 15)
                k = np.where(symbol == 0, 64, k + (symbol >> 4) + 1)
                more = k < 64
                todo, k = todo[more], k[more]
    if (at > end).any():
        raise ValueError("an interval ends early")
    return terms


def thumbnails(streams: list[bytes]) -> list[list[np.ndarray]]:
    """Of each stream of one or more frames back to back, the DC-only luminance thumbnail of each frame."""
    found: list[tuple[int, int, Frame]] = []
    base, whole = 0, b"".join(streams)
    data = np.frombuffer(whole, np.uint8)
    mark = np.flatnonzero(data[:-1] == 0xFF)
    mark = mark[(data[mark + 1] != 0) & (data[mark + 1] != 0xFF)]
    kinds = data[mark + 1]
    for i, stream in enumerate(streams):
        at = 0
        while at < len(stream):
            frame = Frame(stream, at)
            frame.start += base
            a = np.searchsorted(mark, frame.start)
            ends = np.flatnonzero((kinds[a:] & 0xF8) != 0xD0)
            if not len(ends) or kinds[a + ends[0]] != 0xD9 or mark[a + ends[0]] >= base + len(stream):
                raise ValueError("no end of image")
            stops = mark[a : a + ends[0] + 1]
            frame.starts = np.concatenate([[frame.start], stops[:-1] + 2])
            frame.stops = stops
            found.append((i, len(found), frame))
            at = int(stops[-1]) + 2 - base
        base += len(stream)
    # remove the zero after each FF of coded data; positions move by as many
    stuffed = np.zeros(len(data), bool)
    stuffed[1:] = (data[1:] == 0) & (data[:-1] == 0xFF)
    moved = np.concatenate([[0], np.cumsum(stuffed)])
    clean = np.concatenate([data[~stuffed], np.zeros(8, np.uint8)]).astype(np.uint64)
    windows = np.zeros(len(clean) - 4, np.uint64)
    for k in range(5):
        windows = (windows << np.uint64(8)) | clean[k : len(clean) - 4 + k]
    out: list[list[np.ndarray]] = [[] for _ in streams]
    groups: dict[tuple, list[tuple[int, int, Frame]]] = {}
    for x in found:
        groups.setdefault(x[2].layout(), []).append(x)
    shown: dict[int, np.ndarray] = {}
    for group in groups.values():
        counts = []
        for _, _, f in group:
            total = f.mcus[0] * f.mcus[1]
            step = f.interval or total
            own = np.minimum(step, total - step * np.arange(-(-total // step)))
            if len(own) != len(f.starts):
                raise ValueError("the number of intervals is not as the header says")
            counts.append(own)
        start = np.concatenate([f.starts for _, _, f in group])
        stop = np.concatenate([f.stops for _, _, f in group])
        mcus = np.concatenate(counts)
        terms = _decode(windows, (start - moved[start]) * 8, (stop - moved[stop]) * 8, mcus, group[0][2])[0]
        lane = 0
        for (_, number, f), own in zip(group, counts, strict=True):
            c = f.components[0]
            per = c[1] * c[2]
            rows = terms[lane : lane + len(own)]
            lane += len(own)
            flat = np.concatenate([r[: n * per] for r, n in zip(rows, own, strict=True)]) if (own != own[0]).any() else rows[:, : own[0] * per].ravel()
            grid = flat.reshape(f.mcus[1], f.mcus[0], c[2], c[1]).transpose(0, 2, 1, 3).reshape(f.mcus[1] * c[2], f.mcus[0] * c[1])
            full = max(x[1] for x in f.components), max(x[2] for x in f.components)
            wide, high = -(-f.width * c[1] // (8 * full[0])), -(-f.height * c[2] // (8 * full[1]))
            shown[number] = np.clip((grid[:high, :wide] * f.quant[c[3]] + 4) // 8 + 128, 0, 255).astype(np.uint8)
    for i, number, _ in found:
        out[i].append(shown[number])
    return out


def feature(frames: list[np.ndarray]) -> str:
    """Pixel dimensions, and a hash of the thumbnail: which of its 8x8 parts are lighter than their mean."""
    image = np.concatenate(frames)
    high, wide = image.shape
    rows, columns = np.arange(8) * high // 8, np.arange(8) * wide // 8
    if high >= 8 and wide >= 8:
        sums = np.add.reduceat(np.add.reduceat(image.astype(np.int64), rows, axis=0), columns, axis=1)
        area = np.outer(np.diff(rows, append=high), np.diff(columns, append=wide))
        mean = sums / area
    else:
        mean = image[np.ix_(rows, columns)].astype(float)
    bits = np.packbits((mean > mean.mean()).ravel()).tobytes().hex()
    return f"jpeg {wide * 8}x{high * 8} {bits}"


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(texts: list[bytes]) -> list[tuple]:
    """Stores each text's bytes, reads them back from the stored form, and describes both."""
    payloads = [t + bytes([PAD]) * (max(UNIT, -(-len(t) // UNIT) * UNIT) - len(t)) for t in texts]
    stored = pack(payloads)
    out = []
    for text, media, images in zip(texts, stored, thumbnails(stored), strict=True):
        back = b"".join(x.tobytes() for x in images)
        out.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(images)))
    return out


def store(docs: DataFrame, key: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """Key and digest of each row, and with `with_media` the stored bytes themselves."""
    fields = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            data, offsets = text_buffers(batch.column(text))
            for first, last in pieces(offsets, 1 << 19):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(first, last)]
                rows = list(zip(*digest(texts), strict=True))
                columns = [batch.column(key).slice(first, last - first), *(pa.array(x, f) for x, f in zip(rows, fields, strict=True))]
                media = [pa.array(pack([t + bytes([PAD]) * (max(UNIT, -(-len(t) // UNIT) * UNIT) - len(t)) for t in texts]), pa.binary())] if with_media else []
                yield pa.RecordBatch.from_arrays([*columns, *media], [key, *names, *["media"] * with_media])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, {DIGEST}" + ", media binary" * with_media)
