"""The decoder on JPEG files as other encoders make them: AC terms, runs of zeros, colour with subsampling, odd sizes, with and without restarts."""

import numpy as np
import pytest

from terraframe.llm import media


class Bits:
    def __init__(self):
        self.text = []

    def put(self, value, n):
        if n:
            self.text.append(format(value, f"0{n}b"))

    def bytes(self):
        joined = "".join(self.text)
        joined += "1" * (-len(joined) % 8)
        return bytes(int(joined[i : i + 8], 2) for i in range(0, len(joined), 8)).replace(b"\xff", b"\xff\0")


def magnitude(v):
    size = abs(v).bit_length()
    return size, v if v >= 0 else v + (1 << size) - 1


def symbols(block, before):
    """(symbol, extra bits, how many) of a block of 64 terms in zigzag order: DC first."""
    size, extra = magnitude(int(block[0]) - before)
    out, zeros = [(size, extra, size)], 0
    last = max(np.flatnonzero(block[1:]), default=-1) + 1
    for v in block[1 : last + 1].tolist():
        if not v:
            zeros += 1
            continue
        while zeros > 15:
            out.append((0xF0, 0, 0))
            zeros -= 16
        size, extra = magnitude(v)
        out.append((zeros << 4 | size, extra, size))
        zeros = 0
    return out if last == 63 else [*out, (0, 0, 0)]


def table(used):
    """Codes of one length for all, but for the last one, which may not be all ones."""
    used = sorted(used)
    length = max(1, len(used).bit_length())
    return {s: (i, length) for i, s in enumerate(used)}, [len(used) if n == length else 0 for n in range(1, 17)], used


def encode(width, height, sampling, quants, blocks, restart):
    """blocks: for each component (rows of blocks, columns of blocks, 64), of whole MCUs."""
    wide, high = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    order = []  # (component, row, column) in order of the scan; None where a restart stands
    for n, (my, mx) in enumerate(np.ndindex(down, across)):
        if restart and n and n % restart == 0:
            order.append(None)
        order += [(c, my * v + y, mx * h + x) for c, (h, v) in enumerate(sampling) for y in range(v) for x in range(h)]
    before, coded = [0] * len(sampling), []
    for at in order:
        if at is None:
            before = [0] * len(sampling)
            coded.append(None)
            continue
        c, y, x = at
        coded.append((min(c, 1), symbols(blocks[c][y, x], before[c])))
        before[c] = int(blocks[c][y, x, 0])
    dc = [table({s[0][0] for c, s in filter(None, coded) if c == k}) for k in (0, 1) if k < len(sampling)]
    ac = [table({t[0] for c, s in filter(None, coded) if c == k for t in s[1:]} or {0}) for k in (0, 1) if k < len(sampling)]
    scan, part, number = b"", Bits(), 0
    for item in coded:
        if item is None:
            scan += part.bytes() + bytes([0xFF, 0xD0 + number % 8])
            part, number = Bits(), number + 1
            continue
        c, found = item
        for i, (symbol, extra, n) in enumerate(found):
            part.put(*(ac if i else dc)[c][0][symbol])
            part.put(extra, n)
    scan += part.bytes()
    segment = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xFE, b"a comment")
    out += segment(0xDB, b"".join(bytes([i, *q]) for i, q in enumerate(quants)))  # all tables in one segment
    size = height.to_bytes(2, "big") + width.to_bytes(2, "big")
    out += segment(0xC0, b"\x08" + size + bytes([len(sampling)]) + b"".join(bytes([c + 1, h << 4 | v, min(c, len(quants) - 1)]) for c, (h, v) in enumerate(sampling)))
    for kind, tables in ((0, dc), (0x10, ac)):
        for k, (_, bits, values) in enumerate(tables):
            out += segment(0xC4, bytes([kind | k, *bits, *values]))
    if restart:
        out += segment(0xDD, restart.to_bytes(2, "big"))
    out += segment(0xDA, bytes([len(sampling)]) + b"".join(bytes([c + 1, min(c, 1) << 4 | min(c, 1)]) for c in range(len(sampling))) + b"\0\x3f\0")
    return out + scan + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize(("width", "height", "sampling"), [(8, 8, [(1, 1)]), (50, 37, [(1, 1)]), (64, 48, [(1, 1)] * 3), (61, 43, [(2, 2), (1, 1), (1, 1)]), (35, 90, [(2, 1), (1, 1), (1, 1)]), (33, 17, [(1, 2), (1, 1), (1, 1)])])
def test_thumbnails_of_foreign_files(width, height, sampling, restart):
    rng = np.random.default_rng(width)
    wide, high = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    quants = [rng.integers(1, 30, 64).tolist() for _ in range(min(2, len(sampling)))]
    blocks = []
    for h, v in sampling:
        terms = rng.integers(-60, 61, (down * v, across * h, 64)) * (rng.random((down * v, across * h, 64)) < 0.15)
        terms[..., 0] = rng.integers(-1024 // quants[0][0], 1024 // quants[0][0] + 1, terms.shape[:2])
        terms[0, 0, 1:] = 0  # a block without AC terms, and one that needs no end
        terms[-1, -1, 63] = 7
        blocks.append(terms)
    data = encode(width, height, sampling, quants, blocks, restart)
    (images,) = media.thumbnails([data])
    wanted = np.clip((blocks[0][..., 0] * quants[0][0] + 4) // 8 + 128, 0, 255)[: -(-height * sampling[0][1] // (8 * high)), : -(-width * sampling[0][0] // (8 * wide))]
    assert len(images) == 1 and (images[0] == wanted).all()
    with pytest.raises(ValueError):
        media.thumbnails([data[: len(data) // 2]])
