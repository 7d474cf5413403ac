"""Slopes and signs of series against looking at every pair, by one series and through Spark."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terravow.functions import trends


def brute(at, values):
    i, j = np.triu_indices(len(at), 1)
    return float(np.median((values[j] - values[i]) / (at[j] - at[i])))


SHAPES = {
    "few values": lambda r, at: r.integers(0, 5, len(at)).astype(float),
    "decimals": lambda r, at: np.round(r.normal(0, 100, len(at)), 2),
    "doubles": lambda r, at: r.normal(0, 1, len(at)),
    "constant": lambda r, at: np.zeros(len(at)),
    "a line": lambda r, at: 3 * at + 1,
    "mostly a line": lambda r, at: np.where(r.random(len(at)) < 0.7, 2 * at, r.integers(0, 9, len(at))),
    "huge": lambda r, at: r.integers(-(2**52), 2**52, len(at)).astype(float),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("listed", [3, 60, 5000])
def test_median_slope_equals_all_pairs(monkeypatch, shape, listed):
    monkeypatch.setattr(trends, "LISTED", 0)
    monkeypatch.setattr(trends, "PAIRS_AT_ONCE", listed)
    r = np.random.default_rng(listed)
    for n in (2, 3, 4, 17, 60, 200):
        at = np.sort(r.choice(5000, n, replace=False)).astype(float)
        values = SHAPES[shape](r, at)
        assert trends.median_slope(at, values) == pytest.approx(brute(at, values), rel=1e-12 if shape == "decimals" else 0, abs=0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=40))
def test_sign_sum_equals_all_pairs(values):
    assert trends.sign_sum(np.array(values, float)) == sum((b > a) - (b < a) for k, a in enumerate(values) for b in values[k + 1 :])


def test_points_that_are_not_finite_are_left_out():
    at = np.array([0.0, 1, 2, 3, 5])
    assert trends.median_slope(at, np.array([0, np.nan, 4, np.inf, 10.0])) == 2.0
    assert trends.median_slope(at[:1], at[:1]) is None and trends.median_slope(at[:0], at[:0]) is None


def test_a_long_series_takes_seconds():
    r = np.random.default_rng(5)
    at = np.cumsum(r.integers(1, 20, 200_000)).astype(float)
    began = time.time()
    slope = trends.median_slope(at, np.round(r.normal(0, 100, len(at)) + at * 1e-3, 2))
    assert abs(slope - 1e-3) < 1e-5 and time.time() - began < 30  # all 2e10 pairs would take minutes


def test_series_through_spark(spark):
    r = np.random.default_rng(8)
    rows = [(k % 3 if k % 7 else None, k, None if k % 11 == 0 else float(r.integers(0, 50))) for k in range(3000)]
    found = trends.median_slopes(spark.createDataFrame(rows, "k int, t long, v double"), "k", "t", "v").collect()
    assert len(found) == 4
    for key, slope in found:
        own = np.array([(t, v) for k, t, v in rows if k == key and v is not None], float)
        assert slope == brute(own[:, 0], own[:, 1])
