"""The k best (score, id) of each of a bounded number of queries, kept by a task over all that it reads."""

from __future__ import annotations

import math

import numpy as np


def rounded_down(score: int) -> float:
    """A float that is at most ``score``, so that a comparison with it lets too much through, never too little."""
    return float(score) if abs(score) <= 2**53 else math.nextafter(float(score), -math.inf)


class Best:
    """Equal scores go by id, a null id last."""

    def __init__(self, least: np.ndarray, k: int) -> None:
        """``least``: of each query, the score below which nothing can be among its k best."""
        self.k, self.found, self.least = k, [[] for _ in least], np.array(least, "f8")

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: list) -> None:
        """``scores``: a row for each of ``queries``, a column for each of ``ids``; -inf where a pair takes no part."""
        if not scores.size:
            return
        most = scores.max(axis=1)
        for row in np.flatnonzero((most >= self.least[queries]) & (most > -math.inf)):
            own, at = scores[row], queries[row]
            floor = self.least[at]
            if len(own) > self.k:
                floor = max(floor, np.partition(own, -self.k)[-self.k])
            found = self.found[at] + [(-int(own[j]), ids[j] is None, ids[j]) for j in np.flatnonzero((own >= floor) & (own > -math.inf))]
            found.sort(key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))
            self.found[at] = found[: self.k]
            if len(found) >= self.k:
                self.least[at] = max(self.least[at], rounded_down(-self.found[at][-1][0]))
