"""Trend statistics of series: Spark groups by series, numpy counts within one.

A series is the history of one key (a claim's seasons, a user's events); it is sorted and counted within one task, in
n log n steps, so a history of millions of points takes seconds. Lengths are those of histories, not of tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Series of at most so many pairs have their slopes listed; of longer ones at most PAIRS_AT_ONCE are.
LISTED = 500_000
PAIRS_AT_ONCE = 4_000_000


def _inversions(ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs i < j with ranks[i] > ranks[j], by the highest bit in which the two ranks differ.

    Ranks that agree above a bit lie together in their first order, so the pairs of that bit are a one before a zero of
    the same stretch: counted by running sums, without a loop over elements. Yields, a bit at a time, the positions with
    a zero, how many ones each has before it, where these begin in the last array, and the positions with a one.
    """
    order = np.arange(len(ranks))
    for bit in reversed(range(max(1, int(ranks.max(initial=0)).bit_length()))):
        own = ranks[order]
        one = (own >> bit) & 1 == 1
        above = own >> (bit + 1)
        starts = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]])) if len(own) else np.zeros(0, int)
        seen = np.concatenate([[0], np.cumsum(one)])
        first = np.repeat(seen[starts], np.diff(np.append(starts, len(own))))
        zero = ~one
        yield order[zero], (seen[:-1] - first)[zero], first[zero], order[one]
        order = np.concatenate([order[zero], order[one]])


def _ranks(z: np.ndarray) -> np.ndarray:
    return np.unique(z, return_inverse=True)[1].astype("i8")


def _whole(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Doubles as integers over a common denominator, exactly: decimals of few places by a power of ten, else of two."""
    for scale in (10**k for k in range(7)):
        near = np.rint(values * scale)
        if np.abs(near).max(initial=0) < 2**52 and (near / scale == values).all():
            return near.astype("i8"), scale
    pairs = [x.as_integer_ratio() for x in values.tolist()]
    scale = max(q for _, q in pairs)
    return np.array([p * (scale // q) for p, q in pairs], "O"), scale


def sign_sum(values: np.ndarray) -> int:
    """Sum of the signs of all later-minus-earlier differences."""
    n, ranks = len(values), _ranks(np.asarray(values, "f8"))
    ties = np.bincount(ranks) if n else np.zeros(1, int)
    return n * (n - 1) // 2 - int((ties * (ties - 1) // 2).sum()) - 2 * sum(int(c.sum()) for _, c, _, _ in _inversions(ranks))


class _Slopes:
    """The slopes of all pairs of a series, ranked without looking at all pairs.

    Points are integers, and a slope p / q is compared with all others by the order of q * value - p * place: pairs that
    it turns round are steeper the other way. So counts are exact, ties included.
    """

    def __init__(self, at: np.ndarray, values: np.ndarray) -> None:
        self.at, self.values = at, values
        (self.t, self.t_scale), (self.y, self.y_scale) = _whole(at), _whole(values)
        self.n = len(at)
        self.widest = max(abs(int(self.t[0])), abs(int(self.t[-1]))), max(abs(int(self.y.min())), abs(int(self.y.max())))

    def _turned(self, slope: Fraction) -> np.ndarray:
        p, q = slope.numerator, slope.denominator
        t, y = self.t, self.y
        if abs(p) * self.widest[0] + q * self.widest[1] >= 2**62:
            t, y = t.astype("O"), y.astype("O")
        return q * y - p * t

    def count(self, slope: Fraction) -> tuple[int, int]:
        """How many slopes are less than, and how many equal to, this one."""
        ranks = _ranks(self._turned(slope))
        ties = np.bincount(ranks)
        return sum(int(c.sum()) for _, c, _, _ in _inversions(ranks)), int((ties * (ties - 1) // 2).sum())

    def between(self, low: Fraction, high: Fraction, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose slopes lie strictly between the two; about ``most`` of them if given.

        In the order at ``low``, of equals the later first, these are the pairs that the order at ``high`` turns round.
        """
        places = np.arange(self.n)
        order = np.lexsort((-places, _ranks(self._turned(low))))
        ranks = np.empty(self.n, "i8")
        ranks[np.lexsort((places, _ranks(self._turned(high))))] = places
        early, late, got = [], [], 0
        for zeros, counts, first, ones in _inversions(ranks[order]):
            if most is not None:
                fit = int(np.searchsorted(np.cumsum(counts), most - got)) + 1
                zeros, counts, first = zeros[:fit], np.minimum(counts[:fit], most), first[:fit]
            late.append(np.repeat(zeros, counts))
            early.append(ones[np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())])
            got += int(counts.sum())
            if most is not None and got >= most:
                break
        return order[np.concatenate(early)], order[np.concatenate(late)]

    def of(self, i, j):
        return (self.values[j] - self.values[i]) / (self.at[j] - self.at[i])

    def _at_tie(self, slope: Fraction) -> float:
        z = self._turned(slope)
        order = np.lexsort((np.arange(self.n), _ranks(z)))
        at = np.flatnonzero(z[order][1:] == z[order][:-1])[0]
        return float(self.of(order[at], order[at + 1]))

    def _drawn(self, k: int) -> list[Fraction]:
        """Two slopes on either side of the one sought, more or less, from a sample of all pairs."""
        draw = np.random.default_rng(self.n)
        i, j = draw.integers(0, self.n, (2, 400_000))
        i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        sample, share = np.sort(self.of(i, j)), k / (self.n * (self.n - 1) // 2)
        near = [float(sample[int(min(max(share + d, 0), 1) * (len(sample) - 1))]) for d in (-0.004, 0.004)]
        return [(Fraction(x) * self.y_scale / self.t_scale).limit_denominator(1 << 20) for x in near]

    def from_nth(self, k: int) -> np.ndarray:
        """The slope that has k others before it, and some that follow.

        ``low`` and ``high`` close in on it, by counting, until few slopes are left between them; these are listed.
        Steps go by the share that is still to come; where that does not halve the rest, by a slope that is there.
        """
        widest = Fraction(2 * self.widest[1] + 1)
        low, high, below, upto = -widest, widest, 0, self.n * (self.n - 1) // 2
        tries, draw = self._drawn(k), np.random.default_rng(k)
        while (rest := upto - below) > PAIRS_AT_ONCE:
            for slope in tries:
                if low < slope < high:
                    less, equal = self.count(slope)
                    if less <= k < less + equal:
                        return np.array([self._at_tie(slope)])
                    if k < less:
                        high, upto = slope, less
                    else:
                        low, below = slope, less + equal
            if upto - below > rest // 2:
                i, j = self.between(low, high, 1000)
                at = draw.integers(len(i))
                tries = [Fraction(int(self.y[j[at]]) - int(self.y[i[at]]), int(self.t[j[at]]) - int(self.t[i[at]]))]
            else:
                width, share = high - low, Fraction(k - below, upto - below)
                fine = 1 << max(0, 12 - math.floor(math.log2(width)))
                tries = [Fraction(round((low + width * min(max(share + d, Fraction(0)), Fraction(1))) * fine), fine) for d in (Fraction(-1, 20), Fraction(1, 20))]
        return np.sort(self.of(*self.between(low, high)))[k - below :]


def median_slope(at: np.ndarray, values: np.ndarray) -> float | None:
    """Median of all pairwise slopes, exact: n log n a probe. ``at`` rises strictly; points that are not finite are left out.

    The slopes are those of doubles. Only where more than PAIRS_AT_ONCE pairs share the median slope and values have
    decimals can its last bit be another pair's than the sorted list's.
    """
    known = np.isfinite(values) & np.isfinite(at)
    at, values = at[known], values[known]
    n = len(at)
    total = n * (n - 1) // 2
    if not total:
        return None
    first, second = (total - 1) // 2, total // 2
    if total <= LISTED:
        i, j = np.triu_indices(n, 1)
        slopes = np.partition((values[j] - values[i]) / (at[j] - at[i]), [first, second])
        return float((slopes[first] + slopes[second]) / 2)
    slopes = _Slopes(at, values)
    found = slopes.from_nth(first)
    follow = found[second - first] if second - first < len(found) else slopes.from_nth(second)[0]
    return float((found[0] + follow) / 2)


def sign_sums(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, s) of each series; a series of one point has zero."""

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(at, kind="stable")
        return pd.DataFrame({key: frame[key].iloc[:1].to_numpy(), "s": [sign_sum(frame[value].to_numpy("f8"))]})

    return rows.select(key, at, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandas(of, f"{key} {rows.schema[key].dataType.simpleString()}, s long")


def median_slopes(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, slope) of each series of two points or more; places of a series are distinct."""

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(at, kind="stable")
        slope = median_slope(frame[at].to_numpy("f8"), frame[value].to_numpy("f8"))
        return pd.DataFrame({key: frame[key].iloc[:1].to_numpy(), "slope": [slope]})

    found = rows.select(key, at, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandas(of, f"{key} {rows.schema[key].dataType.simpleString()}, slope double")
    return found.where("slope IS NOT NULL")
