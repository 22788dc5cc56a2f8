"""Exact percentiles: any range of doubles, NaN and infinities, brackets that hold much and brackets that miss."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from terraframe.operators import ranks

SHARES = (0.0, 0.05, 0.5, 0.95, 1.0)
RNG = np.random.default_rng(1)
SIGNED = 10.0 ** RNG.uniform(-300, 300, 80_000) * RNG.choice([-1, 1], 80_000)


def plain(values):
    """By sorting, NaN last."""
    values, out = np.sort(np.asarray(values, float)), []
    for s in SHARES:
        p = s * (len(values) - 1)
        a, b = values[math.floor(p)], values[math.ceil(p)]
        out.append(a if a == b or p == math.floor(p) else (math.ceil(p) - p) * a + (p - math.floor(p)) * b)
    return out


CASES = {
    "ends": [1e308, -1e308, 1.7e308, -1.7e308, 5e-324, -5e-324, 0.0, -0.0],
    "decades": SIGNED[:300],
    "many": SIGNED,
    "few_values": RNG.integers(0, 9, 80_000).astype(float),
    "one_value": np.full(70_000, 2.5),
    "infinite": np.r_[RNG.normal(size=70_000), [np.inf] * 9_000, [-np.inf] * 20],
    "no_number": [np.nan, np.nan],
    "some_nan": [1.0, 2.0, 3.0, np.nan],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("told", [1 << 18, 50])
def test_percentiles_equal_those_of_sorted_values(spark, monkeypatch, name, told):
    monkeypatch.setattr(ranks, "TOLD", told)
    df = spark.createDataFrame(pd.DataFrame({"v": np.asarray(CASES[name], float)}).dropna() if name != "no_number" and name != "some_nan" else [(float(v),) for v in CASES[name]], "v double").repartition(5)
    got, row = ranks.order_statistics(df, ["v"], SHARES)
    assert str(got["v"]) == str([float(v) + 0.0 for v in plain(CASES[name])]) and row["__n0"] == len(CASES[name])


def test_a_bracket_that_misses_is_opened(spark, monkeypatch):
    monkeypatch.setattr(ranks, "MARGIN", 1e-9)
    values = RNG.normal(size=70_000)
    df = spark.createDataFrame(pd.DataFrame({"v": values, "w": values[::-1] * 2})).repartition(3)
    assert ranks.percentiles(df, ["v", "w"], SHARES) == {"v": plain(values), "w": plain(values * 2)}


def test_percentiles_equal_sql(spark):
    frame = pd.DataFrame({"v": np.r_[SIGNED[:999], 1e308, -1e308]})
    wanted = [duckdb.connect().execute(f"select quantile_cont(v, {s}) from frame").fetchone()[0] for s in (0.05, 0.5, 0.95)]
    got = ranks.percentiles(spark.createDataFrame(frame), ["v"], (0.05, 0.5, 0.95))["v"]
    assert np.allclose(got, wanted, rtol=1e-12)


def test_two_scans_of_the_source(spark):
    """Rows pass twice whatever the range of values: once for counts and sketch, once for brackets."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.createDataFrame(pd.DataFrame({"v": SIGNED, "w": RNG.normal(size=len(SIGNED))})).repartition(4).mapInArrow(count, "v double, w double")
    assert ranks.percentiles(df, ["v", "w"], SHARES)["v"] == plain(SIGNED)
    assert seen.value == 2 * len(SIGNED)


def test_keys_have_the_order_of_doubles():
    values = np.sort(np.r_[SIGNED, 0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, np.inf, -np.inf])
    keys = ranks.ordered_bits(values)
    assert (np.diff(keys.astype(object)) >= 0).all() and ((np.diff(values) > 0) == (keys[1:] > keys[:-1])).all()
