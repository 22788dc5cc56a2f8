"""Best-fit packing with exact-complement hashing.

Documents become token ids with an end token; those longer than a sequence are cut into pieces of
its length, the last one shorter. How pieces share sequences depends on lengths alone, of which
there are at most `size`, so the plan is made on a histogram of at most `size` counts:

1. From the longest down, the gap that a length leaves is looked up in an index of the single,
   pair and triple sums of the lengths still there, and combinations that fill it exactly are used
   up as often as their counts allow.
2. What is left is placed best-fit: the smallest gap that is large enough, many alike at a time.

The plan is runs (length, first rank, count, first sequence, offset): a piece is placed by its rank
among those of its length, which is a distributed running count, so no length is hot. A run uses up
a length or a class of alike gaps, which bounds the runs by a multiple of `size`; they are broadcast.

Defined results: a null text is an empty one, a document of the end token alone; repeated rows are
packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import bounded, pieces, text_buffers
from .tables import cut, map_arrow, running_sum, spread
from .tokens import tokenizer

SIZE = 4096
END = 1


def tokenize(docs: DataFrame, path: str, size: int = SIZE, end: int = END, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32, and with `with_ids` the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        for batch in bounded(batches):
            data, offsets = text_buffers(batch.column(text))
            for first, last in pieces(offsets, 2 << 20):
                ids, count = words.ids(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                ids = np.insert(ids, np.cumsum(count), end).astype("<u4")
                count = count + 1
                parts = -(-count // size)
                row = np.repeat(np.arange(last - first), parts)
                number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = number * size
                length = np.minimum(size, count[row] - start)
                at = (np.cumsum(count) - count)[row] + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(key).take(pa.array(first + row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, at[-1] + length[-1] if len(at) else 0), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, [key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


class Plan:
    """Runs of pieces of one length that go to successive sequences at one offset."""

    def __init__(self, counts: dict[int, int], size: int = SIZE):
        self.size, self.sequences = size, 0
        self.left = np.zeros(size + 1, np.int64)
        self.used = np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            self.left[length] += n
        self.runs: list[tuple[int, int, int, int, int]] = []
        self._pairs: np.ndarray | None = None
        for length in range(size, 0, -1):
            while self.left[length]:
                found = self._complement(length)
                if found is None:
                    break
                self._fill((length, *found))
        self._best_fit()

    def _take(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.used[length]), n, sequence, offset))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            self._pairs = None

    def _times(self, lengths: tuple[int, ...]) -> int:
        """How often the lengths are there together."""
        return min(int(self.left[x]) // lengths.count(x) for x in lengths)

    def _fill(self, lengths: tuple[int, ...]) -> None:
        n, offset = self._times(lengths), 0
        for length in lengths:
            self._take(length, n, self.sequences, offset)
            offset += length
        self.sequences += n

    def _pair_sums(self) -> np.ndarray:
        """Which sums two of the lengths have; kept until a length is used up."""
        if self._pairs is None:
            here = np.fft.rfft((self.left > 0).astype(float), 2 * self.size + 2)
            self._pairs = np.fft.irfft(here * here, 2 * self.size + 2)[: self.size + 1] > 0.5
        return self._pairs

    def _complement(self, length: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap beside `length` exactly, the largest first."""
        gap = self.size - length
        if gap == 0:
            return ()
        if self._times((length, gap)):
            return (gap,)
        for a in self._pair(gap):
            if self._times((length, a, gap - a)):
                return (a, gap - a)
        largest = np.arange(gap - 1, 0, -1)
        for a in largest[(self.left[largest] > 0) & self._pair_sums()[gap - largest]].tolist():
            for b in self._pair(gap - a):
                if self._times((length, a, b, gap - a - b)):
                    return (a, b, gap - a - b)
        return None

    def _pair(self, total: int) -> list[int]:
        """The larger of each pair of lengths of that sum, largest first."""
        larger = np.arange(total - 1, (total + 1) // 2 - 1, -1)
        return larger[(self.left[larger] > 0) & (self.left[total - larger] > 0)].tolist()

    def _best_fit(self) -> None:
        gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs of sequences (first, count)
        there = np.zeros(self.size + 1, bool)

        def put(gap: int, first: int, n: int) -> None:
            if gap and n:
                gaps[gap].append((first, n))
                there[gap] = True

        for length in range(self.size, 0, -1):
            while n := int(self.left[length]):
                fits = int(there[length:].argmax()) + length
                if there[fits]:
                    first, m = gaps[fits].pop()
                    there[fits] = bool(gaps[fits])
                    k = min(n, m)
                    self._take(length, k, first, self.size - fits)
                    put(fits - length, first, k)
                    put(fits, first + k, m - k)
                    continue
                each = self.size // length
                m, per = (n // each, each) if n >= each else (1, n)
                for i in range(per):
                    self._take(length, m, self.sequences, i * length)
                put(self.size - per * length, self.sequences, m)
                self.sequences += m


def pack(parts: DataFrame, key: str = "doc_id", size: int = SIZE, order: str | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces; `parts` is read twice."""
    counts = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(Plan(counts, size).runs)
    at = np.array([r[:2] for r in runs], np.int64).reshape(-1, 2)
    where = np.array([r[3:] for r in runs], np.int64).reshape(-1, 2)
    most = 1 << 40  # more pieces of a length than a corpus has
    shared = parts.sparkSession.sparkContext.broadcast((at[:, 0] * most + at[:, 1], at[:, 1], where))
    hi, lo = spread(F.col("__hash"))
    salt = F.md5(F.concat_ws("/", F.lit("pack"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, "piece", "ids_crc32")]))
    rows = parts.withColumn("__one", F.lit(1)).withColumn("__hash", salt).withColumn("__hi", hi).withColumn("__lo", lo)
    rows = running_sum(rows, ["length"], "__hi", "__lo", [F.col("__hash"), F.col(key)], "__one", "__rank").drop("__one", "__hash", "__hi", "__lo")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema), "sequence_id long, offset long"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, where = shared.value
        for batch in batches:
            rank = batch.column("__rank").to_numpy()
            run = np.searchsorted(keys, batch.column("length").to_numpy() * most + rank, side="right") - 1
            columns = [batch.column(c) for c in batch.schema.names if c != "__rank"]
            found = where[run] if len(run) else where[:0]
            columns += [pa.array(found[:, 0] + rank - first[run], pa.int64()), pa.array(found[:, 1], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*(c for c in batch.schema.names if c != "__rank"), "sequence_id", "offset"])

    return map_arrow(rows, place, schema)


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenizes and packs whole documents: a row per piece."""
    return pack(cut(tokenize(docs, path, size, end, key, text)), key, size)
