"""Tiles on another grid against plain bilinear sums."""

import random

import pytest

from terravow.sources import mosaic


def plain(tiles, rows, cols):
    surface = {}
    for t, r, c, h in sorted(tiles, key=lambda x: x[0]):
        if h is not None:
            surface.setdefault((r, c), h)
    found = {}
    down, over = ((n - 1) * 5 - 2 for n in (rows, cols))
    for r in range(down // 4 + 1):
        for c in range(over // 4 + 1):
            y, x = (4 * r + 2) / 5, (4 * c + 2) / 5
            near = {(i, j): (1 - abs(y - i)) * (1 - abs(x - j)) for i in range(rows) for j in range(cols) if abs(y - i) < 1 and abs(x - j) < 1}
            near = {k: w for k, w in near.items() if k in surface and w > 1e-9}
            if near:
                found[r, c] = sum(w * surface[k] for k, w in near.items()) / sum(near.values())
    return found, (down // 4 + 1) * (over // 4 + 1)


@pytest.mark.parametrize(("rows", "cols", "holes"), [(9, 12, 0.0), (7, 5, 0.3), (10, 10, 0.85)])
def test_bilinear(spark, rows, cols, holes):
    draw = random.Random(rows)
    tiles = [(0, r, c, draw.randrange(1000)) for r in range(rows // 2 + 1) for c in range(cols)] + [(1, r, c, draw.randrange(1000)) for r in range(rows // 2 - 1, rows) for c in range(cols)]
    tiles = [(t, r, c, None if draw.random() < holes else h) for t, r, c, h in tiles if draw.random() > holes / 2]
    expected, everything = plain(tiles, rows, cols)
    found = mosaic.reprojected(spark.createDataFrame(tiles, "tile int, row int, col int, height long"), rows, cols).collect()
    assert {(r["r"], r["c"]) for r in found} == set(expected)
    for r in found:
        assert r["height"] == pytest.approx(expected[r["r"], r["c"]])
        assert r["coverage"] == pytest.approx(len(expected) / everything) and r["usable"] == (len(expected) >= 0.99 * everything)


def test_no_tiles(spark):
    assert mosaic.reprojected(spark.createDataFrame([], "tile int, row int, col int, height long"), 8, 8).count() == 0
