"""Ranks within keys, and exact percentiles by them, without a task that holds a whole key."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .graph import cut

#: Size of the sketches that bracket a rank, and how far from it (as a share of all values) a bracket ends: some 8 deviations of the sketch's error.
SKETCH, MARGIN = 4096, 0.0021
#: Columns of so few values need no bracket; so many distinct values are told to the driver at most.
FEW, TOLD = 1 << 16, 1 << 18
#: Parts into which brackets with more distinct values are split, pass by pass, by the bits of a value.
PART_BITS = 12
EVERY = [(-math.inf, math.inf)]


def ranked(rows: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """The rows with their place (long, from 1) within a key, by a total order.

    Rows are sorted by range over key and order, so a key may span any number of partitions; rows are
    counted by key and partition, and each is placed within its partition, after those of earlier ones.
    Null keys are a key.
    """
    other = [f"__k{i}" for i in range(len(keys))]
    dealt = rows.withColumns({o: F.col(k) for o, k in zip(other, keys, strict=True)})
    dealt = cut(dealt.repartitionByRange(*other, *order).withColumn("__part", F.spark_partition_id()))
    names = [f"{o}_" for o in other]
    counts = dealt.groupBy(*[F.col(o).alias(n) for o, n in zip(other, names, strict=True)], F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    # a row per key and partition that has it
    before = Window.partitionBy(*names).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    here = dealt.withColumn("__here", F.row_number().over(Window.partitionBy(*other, "__part").orderBy(*order)))
    same = [F.col(o).eqNullSafe(F.col(n)) for o, n in zip(other, names, strict=True)]
    placed = here.join(counts, [*same, F.col("__part") == F.col("__p")])
    return placed.withColumn(out, F.col("__before") + F.col("__here")).drop("__before", "__here", "__p", "__part", *other, *names)


def percentiles(rows: DataFrame, values: list[str], shares: tuple[float, ...]) -> dict[str, list[float | None]]:
    """Exact percentiles of each column by linear interpolation between ranks; None of a column without values."""
    return order_statistics(rows, values, shares)[0]


def order_statistics(rows: DataFrame, values: list[str], shares: tuple[float, ...], *more: Column) -> tuple[dict[str, list[float | None]], Row]:
    """percentiles(), and the row of further aggregates that the first of its two scans takes along.

    The first scan counts values and sketches their distribution; a sketch brackets each rank by two values. The second counts the
    values between brackets and, one by one, the distinct values inside. It finds every rank exactly; brackets of a large table that
    still have many distinct values are kept and split by the bits of their values, which ends after 64 / PART_BITS passes over what was kept. A bracket that
    misses its rank (the counts tell) is opened to all values and the scan repeated. Nothing is sorted, and only counts are shuffled.

    Order and arithmetic: nulls are no values; NaN is greater than infinity, as in Spark's own order; -0.0 is 0.0; interpolation
    is that of doubles, weights first, so it doesn't overflow between the ends of their range, and is NaN between infinities of both signs.
    """
    number = [F.col(v).cast("double") for v in values]
    ordinary = [F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v + F.lit(0.0)) for v in number]
    sizes = [f(c).alias(f"__{n}{i}") for i, (v, o) in enumerate(zip(number, ordinary, strict=True)) for n, f, c in (
        ("n", F.count, v), ("m", F.count, o), ("low", F.count_if, v == float("-inf")), ("high", F.count_if, v == float("inf")),
    )]
    sketches = [F.kll_sketch_agg_double(o, SKETCH).alias(f"__sketch{i}") for i, o in enumerate(ordinary)]
    at = sorted({min(1.0, max(0.0, s + d)) for s in shares for d in (-MARGIN, MARGIN)})
    ends = [F.when(F.col(f"__m{i}") > FEW, F.array(*[F.kll_sketch_get_quantile_double(f"__sketch{i}", F.lit(x)) for x in at])).alias(f"__ends{i}") for i in range(len(values))]
    row = rows.agg(*sizes, *sketches, *more).select("*", *ends).collect()[0]
    # (column, rank from 0 among ordinary values) to find, and brackets of each column that hold them
    place = {(i, s): s * (row[f"__n{i}"] - 1) for i in range(len(values)) for s in shares if row[f"__n{i}"]}
    found: dict[tuple[int, int], float] = {}
    wanted: dict[int, set[int]] = {}
    for (i, _), p in place.items():
        for rank in (math.floor(p), math.ceil(p)):
            inner, m = rank - row[f"__low{i}"], row[f"__m{i}"]
            if 0 <= inner < m:
                wanted.setdefault(i, set()).add(inner)
            else:
                found[i, rank] = float("-inf") if inner < 0 else float("inf") if inner < m + row[f"__high{i}"] else float("nan")
    brackets = {}
    for i in wanted:
        told = dict(zip(at, row[f"__ends{i}"] or [], strict=False))
        pair = lambda s: (told[max(0.0, s - MARGIN)] if s > MARGIN else -math.inf, told[min(1.0, s + MARGIN)] if s < 1 - MARGIN else math.inf)  # noqa: E731, B023
        brackets[i] = _apart([pair(s) for s in shares]) if told else EVERY
    while wanted:
        # what brackets hold is known to a few parts in a thousand of all values
        mass = sum(row[f"__m{i}"] * (2 * MARGIN * len(b) if row[f"__m{i}"] > FEW and b != EVERY else 1) for i, b in brackets.items())
        got = _select(rows, {i: ordinary[i] for i in wanted}, brackets, wanted, 1.5 * mass <= TOLD)
        found |= {(i, rank + row[f"__low{i}"]): v for (i, rank), v in got.items()}
        wanted = {i: left for i, ranks in wanted.items() if (left := {r for r in ranks if (i, r) not in got})}
        brackets = dict.fromkeys(wanted, EVERY)
    out: dict[str, list[float | None]] = {}
    for i, name in enumerate(values):
        out[name] = []
        for s in shares:
            p = place.get((i, s))
            a, b = (found[i, math.floor(p)], found[i, math.ceil(p)]) if p is not None else (None, None)
            out[name].append(a if a == b or p == math.floor(p) else (math.ceil(p) - p) * a + (p - math.floor(p)) * b)
    return out, row


def _apart(ranges: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The ranges in order, those that meet as one."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _select(rows: DataFrame, columns: dict[int, Column], brackets: dict[int, list[tuple[float, float]]], wanted: dict[int, set[int]], few: bool) -> dict[tuple[int, int], float]:
    """(column, rank) -> value of the wanted ranks that lie in brackets, which hold few values or many."""
    each = [F.struct(F.lit(i).alias("c"), v.alias("v")) for i, v in columns.items()]
    long = rows.select((F.explode(F.array(*each)) if len(each) > 1 else each[0]).alias("s")).select("s.*").filter(F.col("v").isNotNull())
    # odd areas are brackets, even ones lie between them
    area, v = F.lit(0), F.col("v")
    for i in columns:
        own = F.lit(2 * len(brackets[i]))
        for k, (lo, hi) in reversed(list(enumerate(brackets[i]))):
            own = F.when(v < lo, 2 * k).when(v <= hi, 2 * k + 1).otherwise(own)
        area = F.when(F.col("c") == i, own).otherwise(area)
    placed = long.withColumn("area", area)
    counts = placed.groupBy("c", "area", F.when(F.col("area") % 2 == 1, v).alias("v")).agg(F.count("*").alias("n"))
    kept = counts if few else cut(counts)
    first = kept.limit(TOLD + 1).collect()
    if len(first) <= TOLD:
        return _walk([(r["c"], r["area"], r["v"], r["n"]) for r in first], wanted)
    kept = cut(counts) if few else kept
    sums = kept.groupBy("c", "area").agg(F.sum("n").alias("n")).collect()
    return _narrow(kept, {(r["c"], r["area"]): r["n"] for r in sums}, wanted)


def _walk(counts: list[tuple[int, int, float | None, int]], wanted: dict[int, set[int]]) -> dict[tuple[int, int], float]:
    """Ranks by going through counts in order; a count of no value is passed over."""
    out = {}
    for i, ranks in wanted.items():
        own = sorted((c for c in counts if c[0] == i), key=lambda c: (c[1], -math.inf if c[2] is None else c[2]))
        ends = np.cumsum([c[3] for c in own])
        for rank in ranks:
            k = int(np.searchsorted(ends, rank, side="right"))
            if k < len(own) and own[k][2] is not None:
                out[i, rank] = own[k][2]
    return out


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """64-bit keys in the order of doubles."""
    bits = np.ascontiguousarray(values, np.float64).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _narrow(kept: DataFrame, sums: dict[tuple[int, int], int], wanted: dict[int, set[int]]) -> dict[tuple[int, int], float]:
    """Ranks among many distinct values: their keys' leading bits first, then those that follow, until few values are left."""
    # (column, rank) -> area and rank within it
    todo = {}
    for i, ranks in wanted.items():
        areas = sorted(a for c, a in sums if c == i)
        ends = np.cumsum([sums[i, a] for a in areas])
        for rank in ranks:
            k = int(np.searchsorted(ends, rank, side="right"))
            if k < len(areas) and areas[k] % 2:
                todo[i, rank] = (i, areas[k], rank - int(ends[k] - sums[i, areas[k]]))
    # ranks that go on alike: (column, area, leading bits) and how many bits these are
    prefix = {key: (c, a, 0) for key, (c, a, _) in todo.items()}
    rest = {key: r for key, (_, _, r) in todo.items()}
    bits = 0
    while bits < 64 and todo:
        step = min(PART_BITS, 64 - bits)
        groups = sorted(set(prefix.values()))
        shift_old, shift_new = 64 - bits, 64 - bits - step

        def count(batches: Iterator[pa.RecordBatch], groups: list = groups, shift_old: int = shift_old, shift_new: int = shift_new, step: int = step) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(groups), 1 << step), np.int64)
            for batch in batches:
                v = batch.column("v")
                use = np.flatnonzero(np.asarray(v.is_valid()))
                key = ordered_bits(v.take(pa.array(use)).to_numpy(zero_copy_only=False))
                c, area, n = (batch.column(x).to_numpy()[use] for x in ("c", "area", "n"))
                head = key >> np.uint64(shift_old) if shift_old < 64 else np.zeros(len(key), np.uint64)
                part = (key >> np.uint64(shift_new)) & np.uint64((1 << step) - 1)
                for g, (gc, ga, gp) in enumerate(groups):
                    own = (c == gc) & (area == ga) & (head == np.uint64(gp))
                    np.add.at(total[g], part[own].astype(np.int64), n[own])
            g, p = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(p, pa.int32()), pa.array(total[g, p])], ["g", "p", "n"])

        told: dict[int, list[tuple[int, int]]] = {}
        for r in kept.mapInArrow(count, "g int, p int, n long").groupBy("g", "p").agg(F.sum("n").alias("n")).orderBy("g", "p").collect():
            told.setdefault(r["g"], []).append((r["p"], r["n"]))
        for key, old in prefix.items():
            own = told[groups.index(old)]
            ends = np.cumsum([n for _, n in own])
            k = int(np.searchsorted(ends, rest[key], side="right"))
            rest[key] -= int(ends[k - 1]) if k else 0
            prefix[key] = (old[0], old[1], old[2] << step | own[k][0])
        bits += step
    keys = np.array([p for _, _, p in prefix.values()], np.uint64)
    values = np.where(keys >> np.uint64(63), keys & np.uint64((1 << 63) - 1), ~keys).view(np.float64)
    return dict(zip(prefix, values.tolist(), strict=True))
