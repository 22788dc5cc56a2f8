"""Spectral indices as columns, their band maps and threshold rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Denominators nearer to 0 than this give null.
NEAR_ZERO = 1e-6
#: Default 1-based band numbers.
DEFAULT_BANDS = {"blue": 1, "green": 2, "red": 3, "nir": 4}
LATER_BANDS = {"swir1": 5, "swir2": 6}

#: Numerator and denominator of each index, from a look-up of bands.
FORMULAS: dict[str, tuple[tuple[str, ...], Callable]] = {
    "ndvi": (("nir", "red"), lambda b: (b["nir"] - b["red"], b["nir"] + b["red"])),
    "ndwi": (("green", "nir"), lambda b: (b["green"] - b["nir"], b["green"] + b["nir"])),
    "mndwi": (("green", "swir1"), lambda b: (b["green"] - b["swir1"], b["green"] + b["swir1"])),
    "ndbi": (("swir1", "nir"), lambda b: (b["swir1"] - b["nir"], b["swir1"] + b["nir"])),
    "savi": (("nir", "red"), lambda b: (1.5 * (b["nir"] - b["red"]), b["nir"] + b["red"] + 0.5)),
    "evi": (("nir", "red", "blue"), lambda b: (2.5 * (b["nir"] - b["red"]), b["nir"] + 6.0 * b["red"] - 7.5 * b["blue"] + 1.0)),
}
EXPECTED = {"evi": 1.5}
USUAL_RANGE = 1.05


def safe_divide(numerator: Column, denominator: Column) -> Column:
    return F.when(F.abs(denominator) >= NEAR_ZERO, numerator / denominator)


def without_nodata(band: Column, nodata: float | None) -> Column:
    """Null where a finite nodata value stands."""
    if nodata is None or nodata != nodata or abs(nodata) == float("inf"):
        return band
    return F.nullif(band.cast("double"), F.lit(float(nodata)))


def index(name: str, bands: Mapping[str, Column]) -> Column:
    return safe_divide(*FORMULAS[name][1](bands))


def near_zero(name: str, bands: Mapping[str, Column]) -> Column:
    """Whether a pixel's denominator is there but too near to 0."""
    return F.abs(FORMULAS[name][1](bands)[1]) < NEAR_ZERO


def resolve_bands(count: int, given: Mapping[str, int] | None = None) -> dict[str, int]:
    """Band numbers by lower-case name; defaults reach as far as the scene has bands."""
    bands = dict(DEFAULT_BANDS) | {n: i for n, i in LATER_BANDS.items() if count >= i}
    for name, number in (given or {}).items():
        if name.lower() not in {**DEFAULT_BANDS, **LATER_BANDS}:
            raise ValueError(f"unknown band {name!r}")
        bands[name.lower()] = int(number)
    return bands


def validate(names: list[str], bands: Mapping[str, int], count: int) -> None:
    """One error that names every index and band that can't be had."""
    problems = [f"unknown index {n!r}" for n in names if n not in FORMULAS]
    for n in names:
        for band in FORMULAS.get(n, ((),))[0]:
            if band not in bands:
                problems.append(f"{n} needs band {band}")
            elif not 1 <= bands[band] <= count:
                problems.append(f"{n}: band {band} is {bands[band]}, the scene has {count}")
    if problems:
        raise ValueError("; ".join(problems))


def threshold(rule: float | str) -> Callable[[Column], Column]:
    """A number or a text such as '>= 0.3' as a test of a column; a bare number means above."""
    text = str(rule).strip()
    tests = {">=": lambda v: lambda c: c >= v, "<=": lambda v: lambda c: c <= v, ">": lambda v: lambda c: c > v, "<": lambda v: lambda c: c < v}
    sign = next((s for s in tests if text.startswith(s)), "")
    return tests[sign or ">"](float(text[len(sign) :].strip()))


def thresholds(rules) -> dict[str, Callable[[Column], Column]]:
    """Label -> test, of a number, a map of labels to rules or a list of rules."""
    if rules is None:
        return {}
    if isinstance(rules, (int, float)):
        return {f">{float(rules)}": threshold(rules)}
    if isinstance(rules, Mapping):
        return {str(label): threshold(rule) for label, rule in rules.items()}
    return {str(rule): threshold(rule) for rule in rules}


def range_flag(name: str, least: Column, most: Column) -> Column:
    """Code of the warning that an index's extent calls for, or null."""
    limit = EXPECTED.get(name, USUAL_RANGE)
    return F.when(least.isNull(), F.lit("empty_index")).when((least < -limit) | (most > limit), F.lit("index_value_out_of_range"))
