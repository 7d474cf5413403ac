"""The hydrology chain in small tiles against plain work on whole grids."""

import heapq
import random

import pytest

from terravow.operators import hydrology as h
from terravow.operators.raster_queries import D8

STEPS = list(D8.values())


def grid(seed, rows, cols, kinds, holes=0.05):
    r = random.Random(seed)
    return {(i, j): float(r.randrange(kinds)) for i in range(rows) for j in range(cols) if r.random() > holes}


def plain_fill(z):
    filled, queue = {}, []
    for (i, j), v in z.items():
        if any((i + a, j + b) not in z for a, b in STEPS):
            filled[i, j] = v
            queue.append((v, i, j))
    heapq.heapify(queue)
    while queue:
        v, i, j = heapq.heappop(queue)
        for a, b in STEPS:
            x = (i + a, j + b)
            if x in z and x not in filled:
                filled[x] = max(z[x], v)
                heapq.heappush(queue, (filled[x], *x))
    return filled


@pytest.mark.parametrize(("seed", "rows", "cols", "kinds", "tile"), [(1, 13, 17, 1000, 4), (2, 20, 9, 5, 5), (3, 16, 16, 1, 4), (4, 6, 6, 50, 64)])
def test_against_whole_grids(spark, seed, rows, cols, kinds, tile):
    z = grid(seed, rows, cols, kinds)
    cells = spark.createDataFrame([(i - 3, j + 5, v, 1) for (i, j), v in z.items()] + [(0, 0, None, 1)], "row int, col int, height double, basin int")
    found = {(r["row"] + 3, r["col"] - 5): r for r in h.hydrology(cells, threshold=3, tile=tile).collect()}
    assert set(found) == set(z)
    level = plain_fill(z)
    assert {x: r["filled"] for x, r in found.items()} == level
    down = {}
    for (i, j), r in found.items():
        near = {p: (i + a, j + b) for p, (a, b) in D8.items()}
        drops = {p: (level[i, j] - level[x]) / (D8[p][0] ** 2 + D8[p][1] ** 2) ** 0.5 for p, x in near.items() if x in level}
        if drops and max(drops.values()) > 0:
            assert drops[r["pointer"]] == max(drops.values())
        elif len(drops) < 8:
            assert r["pointer"] == 0  # it leaves the grid here
        else:
            assert level[near[r["pointer"]]] == level[i, j]
        if r["pointer"]:
            down[i, j] = near[r["pointer"]]
        rises = [abs(z[i, j] - z[x]) / (D8[p][0] ** 2 + D8[p][1] ** 2) ** 0.5 for p, x in near.items() if x in z]
        assert r["slope"] == pytest.approx(max(rises, default=0) / h.CELL)
    up = {}
    for x, y in down.items():
        up.setdefault(y, []).append(x)
    for x in z:  # every cell drains out, without a circle
        seen = 0
        while x in down:
            x, seen = down[x], seen + 1
            assert seen <= len(z)

    def flow(x):
        return 1 + sum(map(flow, up.get(x, [])))

    def order(x):
        above = sorted((order(y) for y in up.get(x, []) if flow(y) >= 3), reverse=True)
        return 1 if not above else above[0] + (len(above) > 1 and above[0] == above[1])

    for x, r in found.items():
        assert r["flow"] == flow(x)
        assert r["order"] == (order(x) if flow(x) >= 3 else 0)


def test_empty_grid(spark):
    assert h.hydrology(spark.createDataFrame([], "row int, col int, height double"), 3).count() == 0


def test_the_grid_grows_with_the_table(spark):
    small, larger = (h.terrain(spark, f"/root/testdata/{d}").count() for d in ("sf0.001", "sf0.01"))
    assert larger > 7 * small
