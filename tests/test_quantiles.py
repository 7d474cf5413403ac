"""Quantiles by counting against sorting each group whole."""

import math
import random

import numpy as np
import pytest

from terravow.operators import quantiles

ASKED = {"low": 0.1, "middle": 0.5, "high": 0.9, "least": 0.0, "most": 1.0}


def expected(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if low == high else low + (high - low) * (at - math.floor(at))


def groups():
    random.seed(4)
    wide = [random.choice([-1, 1]) * 10.0 ** random.uniform(-300, 300) for _ in range(900)]
    return {
        "smooth": [random.gauss(0, 1) for _ in range(3000)],
        "a third equal": [7.0] * 1000 + [random.gauss(7, 1) for _ in range(2000)],
        "all equal": [3.25] * 2000,
        "all scales": wide,
        "an outlier": [1e300, *(random.random() for _ in range(1500))],
        "extremes": [math.inf, -math.inf, 1.7e308, -1.7e308, 5e-324, 0.0, -0.0] * 40,
        "one": [2.5],
        None: [float(k) for k in range(700)],
    }


@pytest.mark.parametrize("limit", [30, 200_000])
def test_equal_to_sorting(spark, limit):
    held = groups()
    rows = [(name, x, 1, 2) for name, xs in held.items() for x in [*xs, None, math.nan]]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "name string, x double, _g int, n int").repartition(5)
    found = {r["name"]: r for r in quantiles.exact_quantiles(df, ["name"], "x", ASKED, limit=limit).collect()}
    assert set(found) == set(held)
    for name, xs in held.items():
        assert found[name]["n"] == len(xs)
        for q, p in ASKED.items():
            assert found[name][q] == expected(xs, p) or math.isnan(expected(xs, p)), (name, q)


def test_one_group_of_all_rows(spark):
    rows = spark.range(300_000, numPartitions=6).selectExpr("id * 7919 % 300007 / 16 AS x")
    found = quantiles.exact_quantiles(rows, [], "x", {"p": 0.37, "median": 0.5}, limit=1000).first()
    own = np.array([k * 7919 % 300007 / 16 for k in range(300_000)])
    assert (found["n"], found["p"], found["median"]) == (300_000, expected(own, 0.37), float(np.median(own)))


def test_no_task_holds_a_group(spark):
    """What is shuffled for a large group is bins, not values, until few are left."""
    rows = spark.range(100_000, numPartitions=4).selectExpr("rand(3) AS x")
    sizes = []
    narrowed = quantiles._narrowed

    def watched(values, sought, by_logarithm):
        out = narrowed(values, sought, by_logarithm)
        sizes.append([r["_inside"] for r in out.collect()])
        return out

    quantiles._narrowed = watched
    try:
        quantiles.exact_quantiles(rows, [], "x", {"median": 0.5}, limit=500).collect()
    finally:
        quantiles._narrowed = narrowed
    assert len(sizes) == 1 and all(n < 300 for n in sizes[0])


def test_empty(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "k int, x double"), ["k"], "x", {"m": 0.5}).count() == 0
    assert quantiles.exact_quantiles(spark.createDataFrame([(1, None)], "k int, x double"), ["k"], "x", {"m": 0.5}).count() == 0
