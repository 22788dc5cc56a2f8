"""Greedy non-maximum suppression.

Copies of a box count once, by its best rank, as whatever decides on that one decides on the others. The boxes of a key that a task holds (HELD) are settled there, band by band: the best of those left are compared with each other,
and what the kept ones overlap is dropped before any later pair is looked at. Kept boxes meet only groups of boxes
that lie near them, by bounding boxes of runs along a curve. A pile of boxes costs its kept boxes times its height, not its square.

Keys with more boxes go by the same bands as joins. A band is a range of ranks, twice as long as the one before. Its conflicts are found through
grids, one for each size class of boxes (powers of two of the longer side): a box stands in the cells of its own class and of larger
ones that it can conflict with (an overlap of t asks for sides of at least t times the other's), and a pair is tested in
the one cell that holds the corner of its intersection. A box of the band is kept when all better-ranked boxes that it conflicts with are suppressed, suppressed when one
of them is kept, which is decided in rounds of joins, or in one task where there are few conflicts. Then kept boxes meet the boxes of later bands in
the same grids, and what they overlap is dropped. So conflicts among boxes that a better one suppresses are never made.

All of this gives what going through the boxes by rank gives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box_area
from . import ranks
from .graph import EDGES, cut

#: Sides of boxes are classed from 2 to the power of this to its inverse.
LEAST_LEVEL = -40
#: The key's name in tables of conflicts.
KEY = "__key"
#: Boxes of a key that one task settles, boxes of a band in it, and of a run of near ones.
HELD, BATCH, RUN = 1 << 16, 512, 128
#: Ranks in the first band of a larger key.
BAND = 1024


def _level(bbox: Column) -> Column:
    longer = F.greatest(bbox[2] - bbox[0], bbox[3] - bbox[1])
    return F.greatest(F.lit(LEAST_LEVEL), F.least(F.lit(-LEAST_LEVEL), F.when(longer > 0, F.ceil(F.log2(longer))).otherwise(LEAST_LEVEL))).cast("int")


def conflicts(boxes: DataFrame, threshold: float, key: str = "raster_id", across: bool = False) -> DataFrame:
    """(KEY, better, worse): ranks of pairs whose IoU is at least the threshold. `boxes`: key, rank, bbox and `later`, a boolean.

    Pairs are those of boxes that are alike in `later`, or with `across` those of boxes that are not.
    """
    boxes = cut(boxes.select(key, "rank", "bbox", "later", _level(F.col("bbox")).alias("level")))
    # at most 2 * LEAST_LEVEL + 1 numbers
    levels = sorted(r["level"] for r in boxes.select("level").distinct().collect())
    reach = math.ceil(math.log2(1 / threshold)) + 1 if threshold < 1 else 1
    cell = lambda v, at: F.floor(v / F.pow(F.lit(2.0), at)).cast("long")
    span = lambda i: F.explode(F.sequence(cell(F.col("bbox")[i], F.col("at")), cell(F.col("bbox")[i + 2], F.col("at"))))
    larger = F.filter(F.array(*map(F.lit, levels)), lambda x: (x >= F.col("level")) & (x <= F.col("level") + reach))
    cells = boxes.withColumn("at", F.explode(larger)).withColumn("cx", span(0)).withColumn("cy", span(1))
    a, b = cells.filter(F.col("at") == F.col("level")).alias("a"), cells.alias("b")
    left, right = F.col("a.bbox"), F.col("b.bbox")
    x, y = F.greatest(left[0], right[0]), F.greatest(left[1], right[1])
    w, h = F.greatest(F.lit(0.0), F.least(left[2], right[2]) - x), F.greatest(F.lit(0.0), F.least(left[3], right[3]) - y)
    union = box_area(left) + box_area(right) - w * h
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (key, "at", "cx", "cy")]
    same.append((~F.col("a.later") if across else F.col("a.later")) == F.col("b.later"))
    once = (F.col("b.level") < F.col("a.level")) | (F.col("a.rank") < F.col("b.rank"))
    alike = once & (F.col("a.rank") != F.col("b.rank")) & (cell(x, F.col("a.at")) == F.col("a.cx")) & (cell(y, F.col("a.at")) == F.col("a.cy")) & (union > 0) & (w * h >= threshold * union)
    return a.join(b, [*same, alike]).select(F.col(f"a.{key}").alias(KEY), F.least("a.rank", "b.rank").alias("better"), F.greatest("a.rank", "b.rank").alias("worse"))


def suppress(records: DataFrame, threshold: float, order: list[Column], key: str = "raster_id") -> DataFrame:
    """The records that greedy suppression keeps, with their rank; records without a box are kept.

    `order` must be total within a key: score descending, then input order. A null key is a key.
    """
    ranked = cut(ranks.ranked(records, [key], order))
    if threshold <= 0:
        return ranked
    kind = ranked.schema[key].dataType.simpleString()
    first = cut(_without_copies(ranked.select(key, "rank", F.transform("bbox", lambda v: v.cast("double")).alias("bbox")), threshold, key))
    boxes = first.filter(F.col("bbox").isNotNull())
    sizes = cut(boxes.groupBy(F.col(key).alias(KEY)).agg(F.count("*").alias("n")))
    of_key = F.col(key).eqNullSafe(F.col(KEY))
    few = boxes.join(sizes.filter(F.col("n") <= HELD), of_key, "left_semi")
    gone = few.groupBy(key).applyInArrow(lambda table: _settle(table, threshold), f"`{KEY}` {kind}, rank long")
    many = sizes.filter(F.col("n") > HELD)
    if not many.isEmpty():
        # a null key would meet no other in joins by key
        gone = gone.union(_bands(boxes.join(many, of_key, "left_semi").filter(F.col(key).isNotNull()), threshold, key))
        if not many.filter(F.col(KEY).isNull()).isEmpty():
            gone = gone.union(_bands(boxes.filter(F.col(key).isNull()).withColumn(key, F.lit(0)), threshold, key).withColumn(KEY, F.lit(None).cast(kind)))
    there = [of_key, F.col("rank") == F.col("__rank")]
    kept = first.join(gone.withColumnRenamed("rank", "__rank"), there, "left_anti").select(F.col(key).alias(KEY), F.col("rank").alias("__rank"))
    return ranked.join(kept, there, "left_semi")


def _without_copies(boxes: DataFrame, threshold: float, key: str) -> DataFrame:
    """The rows (key, rank, bbox) without boxes that equal a better-ranked one of their key.

    That one suppresses them, or what suppresses it does. Rows without a box and boxes that don't meet themselves (no area, or not a finite one) all stay.
    """
    area = box_area(F.col("bbox"))
    meets = (area > 0) & (area + area < float("inf")) & F.lit(threshold <= 1)
    return boxes.groupBy(key, "bbox", F.when(meets, F.lit(None)).otherwise(F.col("rank")).alias("alone")).agg(F.min("rank").alias("rank")).select(key, "rank", "bbox")


def _overlaps(boxes: np.ndarray, others: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each box's IoU with each other is at least the threshold."""
    a, b = boxes[:, None], others[None]
    w = np.maximum(0.0, np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0]))
    h = np.maximum(0.0, np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1]))
    area = lambda x: np.maximum(0.0, x[..., 2] - x[..., 0]) * np.maximum(0.0, x[..., 3] - x[..., 1])
    union = area(a) + area(b) - w * h
    return (union > 0) & (w * h >= threshold * union)


def _curve(boxes: np.ndarray) -> np.ndarray:
    """An order in which boxes of the same size class that follow one another lie near each other."""
    longer = np.maximum(boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1])
    level = np.ceil(np.log2(np.where(longer > 0, longer, 1.0)))
    centre = (boxes[:, :2] + boxes[:, 2:]) / 2
    span = np.ptp(centre, axis=0)
    place = ((centre - centre.min(axis=0)) / np.where(span > 0, span, 1.0) * 0xFFFF).astype(np.uint64)
    mixed = np.zeros(len(boxes), np.uint64)
    for bit in range(16):
        for i in (0, 1):
            mixed |= (place[:, i] >> np.uint64(bit) & np.uint64(1)) << np.uint64(2 * bit + i)
    return np.lexsort((mixed, level))


def _settle(table: pa.Table, threshold: float) -> pa.Table:
    """The boxes of a key that are suppressed."""
    rank = table.column("rank").to_numpy()
    boxes = np.array(table.column("bbox").to_pylist(), np.float64).reshape(-1, 4)
    order = np.argsort(rank)
    rank, boxes = rank[order], boxes[order]
    n, near = len(rank), _curve(boxes)
    edges = np.arange(0, n, RUN)
    # bounds of runs of near boxes
    low = np.minimum.reduceat(boxes[near, :2], edges, axis=0)
    high = np.maximum.reduceat(boxes[near, 2:], edges, axis=0)
    runs = np.minimum(edges[:, None] + np.arange(RUN), n - 1)
    place = np.empty(n, np.int64)
    place[near] = np.arange(n)
    alive, gone, at = np.ones(n, bool), np.zeros(n, bool), 0
    while at < n:
        band = at + np.flatnonzero(alive[at:])[:BATCH]
        if not len(band):
            break
        hit = _overlaps(boxes[band], boxes[band], threshold)
        out = np.zeros(len(band), bool)
        for i in range(len(band)):
            if not out[i]:
                out[i + 1 :] |= hit[i, i + 1 :]
        gone[band[out]] = True
        kept = band[~out]
        at = int(band[-1]) + 1
        alive[:at] = False
        kept = kept[np.argsort(place[kept])]
        for first in range(0, len(kept), RUN // 4):
            some = boxes[kept[first : first + RUN // 4]]
            touched = np.flatnonzero(((low <= some[:, 2:].max(axis=0)) & (high >= some[:, :2].min(axis=0))).all(axis=1))
            left = near[np.unique(runs[touched])]
            left = left[alive[left]]
            if len(left):
                lost = left[_overlaps(some, boxes[left], threshold).any(axis=0)]
                alive[lost], gone[lost] = False, True
    keys = table.column(0).slice(0, 1).combine_chunks().take(pa.array(np.zeros(int(gone.sum()), np.int64)))
    return pa.table([keys, pa.array(rank[gone])], [KEY, "rank"])


def _bands(boxes: DataFrame, threshold: float, key: str) -> DataFrame:
    """(KEY, rank) of suppressed boxes of keys that no task holds."""
    left, end, size, gone = cut(boxes), 0, BAND, []
    while not left.isEmpty():
        end += size
        size *= 2
        here, rest = left.filter(F.col("rank") <= end), left.filter(F.col("rank") > end)
        lost = _decide(conflicts(here.withColumn("later", F.lit(False)), threshold, key), boxes.schema[key].dataType.simpleString())
        names = [F.col(KEY).alias("k"), F.col("rank").alias("r")]
        lost = lost.select(*names)
        there = [F.col(key) == F.col("k"), F.col("rank") == F.col("r")]
        kept = cut(here.join(lost, there, "left_anti"))
        both = kept.withColumn("later", F.lit(False)).union(rest.withColumn("later", F.lit(True)))
        dropped = cut(conflicts(both, threshold, key, across=True).select(F.col(KEY).alias("k"), F.col("worse").alias("r")).distinct())
        gone += [lost, dropped]
        left = cut(rest.join(dropped, there, "left_anti"), left)
    every = gone[0]
    for more in gone[1:]:
        every = every.union(more)
    return every.select(F.col("k").alias(KEY), F.col("r").alias("rank"))


def _decide(pairs: DataFrame, kind: str) -> DataFrame:
    """(KEY, rank) of the boxes that conflicts among all their boxes suppress: rounds of joins, and one task for the last."""
    pairs = cut(pairs)
    # conflicts whose worse end is undecided; an end is settled once
    gone = []
    while True:
        if pairs.count() <= EDGES:
            gone.append(cut(pairs.coalesce(1).mapInArrow(_settled, f"`{KEY}` {kind}, rank long"), pairs))
            break
        waiting = pairs.select(KEY, F.col("worse").alias("rank")).distinct()
        sure = pairs.select(KEY, F.col("better").alias("rank")).distinct().join(waiting, [KEY, "rank"], "left_anti")
        lost = cut(pairs.join(sure.withColumnRenamed("rank", "better"), [KEY, "better"], "left_semi").select(KEY, F.col("worse").alias("rank")).distinct())
        gone.append(lost)
        out = lost.select(F.col(KEY).alias("k"), F.col("rank").alias("r"))
        pairs = cut(pairs.join(out, [F.col(KEY) == F.col("k"), F.col("worse") == F.col("r")], "left_anti").join(out, [F.col(KEY) == F.col("k"), F.col("better") == F.col("r")], "left_anti"), pairs)
    every = gone[0]
    for more in gone[1:]:
        every = every.union(more)
    return every


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The boxes that the conflicts of one task suppress: the same rounds, over arrays."""
    held = [x for x in batches if len(x)]
    if not held:
        return
    table = pa.Table.from_batches(held)
    keys = table.column(KEY).combine_chunks().dictionary_encode()
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    names, of = keys.dictionary, keys.indices.to_numpy().astype(np.int64)
    better, worse = table.column("better").to_numpy(), table.column("worse").to_numpy()
    most = int(worse.max()) + 1
    boxes, ends = np.unique(np.concatenate([of * most + better, of * most + worse]), return_inverse=True)
    a, b = ends[: len(of)], ends[len(of) :]
    gone = np.zeros(len(boxes), bool)
    while len(a):
        waiting = np.zeros(len(boxes), bool)
        waiting[b] = True
        gone[b[~waiting[a]]] = True
        open_ = ~(gone[a] | gone[b])
        a, b = a[open_], b[open_]
    out = boxes[gone]
    yield pa.RecordBatch.from_arrays([names.take(pa.array(out // most)), pa.array(out % most)], [KEY, "rank"])
