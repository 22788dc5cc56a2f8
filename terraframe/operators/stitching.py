"""Overlap-blended stitching of tile results: one aggregate over pixels and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WEIGHT, LEAST_TOTAL = 1e-3, 1e-6
#: Least and most of integer sample types.
RANGES = {"uint8": (0, 255), "uint16": (0, 65535), "int16": (-32768, 32767), "int32": (-(2**31), 2**31 - 1)}


def _tent(i: Column, n: Column) -> Column:
    return F.least(i + 1, n - i).cast("double") / F.floor((n + 1) / 2).cast("double")


def centre_weight(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Weight of a pixel of a tile by its place in it: highest at the centre."""
    return F.greatest(F.lit(LEAST_WEIGHT), _tent(x, width) * _tent(y, height))


def stitch(pieces: DataFrame, value: str, by: list[str], weight: Column) -> DataFrame:
    """Weighted mean of `value` over the tiles that hold a pixel; `by` are its coordinates (and class)."""
    total = F.greatest(F.sum(weight), F.lit(LEAST_TOTAL))
    return pieces.groupBy(*by).agg((F.sum(F.col(value) * weight) / total).alias(value))


def stitch_uniform(pieces: DataFrame, value: str, by: list[str]) -> DataFrame:
    return pieces.groupBy(*by).agg((F.sum(value) / F.greatest(F.count(value), F.lit(1))).alias(value))


def to_samples(value: Column, dtype: str) -> Column:
    """Half-even rounded and clamped for integer types."""
    if dtype not in RANGES:
        return value
    least, most = RANGES[dtype]
    return F.least(F.lit(most), F.greatest(F.lit(least), F.rint(value))).cast("long")


def argmax(probabilities: Column) -> Column:
    """Number of the greatest entry; the first of ties."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def pad_channels(probabilities: Column, count: int) -> Column:
    return F.concat(probabilities, F.array_repeat(F.lit(0.0), F.lit(count) - F.size(probabilities)))


def one_hot(mask: Column, count: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda c: (c == mask).cast("double"))


def match_bands(bands: Column, count: int) -> Column:
    """The first bands, or the last one repeated."""
    more = F.greatest(F.lit(0), F.lit(count) - F.size(bands))
    return F.slice(F.concat(bands, F.array_repeat(F.element_at(bands, -1), more)), 1, count)
