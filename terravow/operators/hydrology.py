"""Hydrology of a height grid in tiles: depressions filled, flow directions, accumulation, stream orders, slopes.

A cell is a row (row, col, height); a cell that is not there is outside, and water leaves the grid beside it. Work is
done in tiles of ``TILE`` squared cells, each with a frame of its neighbours' cells, so a task holds one tile whatever
the grid's size.

* Depressions: each tile is flooded from its edge. Every edge cell is a basin; where two basins meet, the lower of the
  passes between them is an edge of the spill graph, which tiles share. A basin's water level is the least, over all
  ways out, of the highest pass on the way. The graph is contracted: every basin joins the one over its lowest pass,
  all at once, and its level is at least that pass, until all have joined the outside. Rounds are logarithmic, and no
  task or driver holds the graph.
* Directions: to the steepest lower neighbour; on flats towards the nearest way off. Distances on flats and the orders
  of streams are settled within tiles, and what changes on a tile's edge is told to its neighbours in the next round.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import written
from ..plans.registry import query
from ..sources import adapter as a
from .raster_queries import D8, accumulate

TILE = 256
OUTSIDE = -(1 << 62)
#: Metres between the centres of neighbouring cells.
CELL = 30.0
_ID, _NONE = 1 << 31, -(1 << 63)
_STEPS = list(D8.values())


def tiled(cells: DataFrame, tile: int, work: Callable[[pd.DataFrame, int, int], Iterator[pd.DataFrame] | pd.DataFrame], shape: str) -> DataFrame:
    """``work`` on every tile that has cells: its own and, marked ``_own`` false, those around it."""
    around = [F.struct(F.floor((F.col("row") + dr) / tile).alias("tr"), F.floor((F.col("col") + dc) / tile).alias("tc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
    rows = cells.withColumn("_tile", F.explode(F.array_distinct(F.array(*around))))
    own = (F.floor(F.col("row") / tile) == F.col("_tile.tr")) & (F.floor(F.col("col") / tile) == F.col("_tile.tc"))
    rows = rows.select("*", own.alias("_own"), F.col("_tile.tr").alias("_tr"), F.col("_tile.tc").alias("_tc")).drop("_tile")

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        if not frame["_own"].any():
            return work(frame.iloc[:0], 0, 0)
        return work(frame, int(frame["_tr"].iloc[0]) * tile - 1, int(frame["_tc"].iloc[0]) * tile - 1)

    return rows.groupBy("_tr", "_tc").applyInPandas(of, shape)


def _grid(frame: pd.DataFrame, column: str, top: int, left: int, side: int, empty=np.nan, kind="f8") -> np.ndarray:
    grid = np.full((side, side), empty, kind)
    grid[frame["row"].to_numpy() - top, frame["col"].to_numpy() - left] = frame[column].to_numpy()
    return grid


def _around(grid: np.ndarray) -> np.ndarray:
    """For each of the eight steps, the neighbours of all cells but the frame's."""
    side = len(grid)
    return np.stack([grid[1 + dr : side - 1 + dr, 1 + dc : side - 1 + dc] for dr, dc in _STEPS])


# --- depressions


def _flooded(tile: int) -> Callable[[pd.DataFrame, int, int], pd.DataFrame]:
    """Rows of cells (row, col, height, filled, basin) and rows of the spill graph (basin, other, pass)."""
    names = ["row", "col", "height", "filled", "basin", "other", "pass"]

    def work(frame: pd.DataFrame, top: int, left: int) -> pd.DataFrame:
        if frame.empty:
            return pd.DataFrame({n: [] for n in names})
        side = tile + 2
        height = _grid(frame, "height", top, left, side)
        own = _grid(frame, "_own", top, left, side, False, bool)
        outlet = np.zeros_like(own)
        outlet[1:-1, 1:-1] = np.isnan(_around(height)).any(axis=0)
        outlet &= own
        edge = own.copy()
        edge[2:-2, 2:-2] = False
        ident = lambda r, c: (r + top) * _ID + c + left
        filled, basin = height.copy(), np.full(own.shape, _NONE, "i8")
        passes: dict[tuple[int, int], float] = {}

        def met(x: int, y: int, level: float) -> None:
            pair = (x, y) if x < y else (y, x)
            if level < passes.get(pair, np.inf):
                passes[pair] = level

        queue = []
        for r, c in zip(*(x.tolist() for x in np.nonzero(edge | outlet)), strict=True):
            basin[r, c] = ident(r, c)
            queue.append((height[r, c], r, c))
            if outlet[r, c]:
                met(OUTSIDE, int(basin[r, c]), float(height[r, c]))
        heapq.heapify(queue)
        while queue:
            level, r, c = heapq.heappop(queue)
            for dr, dc in _STEPS:
                x, y = r + dr, c + dc
                if own[x, y]:
                    if basin[x, y] == _NONE:
                        basin[x, y] = basin[r, c]
                        filled[x, y] = max(height[x, y], level)
                        heapq.heappush(queue, (filled[x, y], x, y))
                    elif basin[x, y] != basin[r, c]:
                        met(int(basin[r, c]), int(basin[x, y]), float(max(level, filled[x, y])))
                elif not np.isnan(height[x, y]):  # the neighbouring tile's edge cell is a basin there
                    met(int(basin[r, c]), ident(x, y), float(max(level, height[x, y])))
        rows, cols = np.nonzero(own)
        cells = pd.DataFrame({"row": rows + top, "col": cols + left, "height": height[own], "filled": filled[own], "basin": basin[own], "other": pd.array([None] * len(rows), "Int64"), "pass": np.nan})
        graph = pd.DataFrame([(None, None, np.nan, np.nan, x, y, w) for (x, y), w in passes.items()], columns=names)
        return pd.concat([cells.astype({"row": "Int64", "col": "Int64"}), graph.astype({"row": "Int64", "col": "Int64", "other": "Int64"})])

    return work


def levels(graph: DataFrame) -> DataFrame:
    """(basin, level) over a spill graph (basin, other, pass): the least highest pass on a way to OUTSIDE.

    A basin, and later a group of basins, joins the one beyond its lowest pass; equal passes go by the pair's numbers,
    so only pairs can join each other, and of these the smaller is the group's new name.
    """
    both = lambda e: e.select(F.col("basin").alias("x"), F.col("other").alias("y"), "pass").unionByName(e.select(F.col("other").alias("x"), F.col("basin").alias("y"), "pass"))
    edges = written(graph.groupBy(F.least("basin", "other").alias("basin"), F.greatest("basin", "other").alias("other")).agg(F.min("pass").alias("pass")), "passes")
    found = both(edges).where(F.col("x") != OUTSIDE).select(F.col("x").alias("basin")).distinct()
    found = written(found.select("basin", F.col("basin").alias("group"), F.lit(float("-inf")).alias("level")), "levels")
    while not edges.isEmpty():
        best = F.min(F.struct("pass", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).alias("best")
        picked = both(edges).where(F.col("x") != OUTSIDE).groupBy("x").agg(best)
        next_ = F.col("best.a") + F.col("best.b") - F.col("x")
        picked = written(picked.select("x", next_.alias("to"), F.col("best.pass").alias("pass")), "picked")
        back = picked.select(F.col("x").alias("to"), F.col("to").alias("_back"))
        up = picked.join(back, "to", "left").select("x", F.when((F.col("_back") == F.col("x")) & (F.col("x") < F.col("to")), F.col("x")).otherwise(F.col("to")).alias("to"))
        while True:  # each chain of picks is halved in every round
            up = written(up, "up")
            step = up.select(F.col("x").alias("to"), F.col("to").alias("_far"))
            after = up.join(step, "to", "left").select("x", "to", F.coalesce("_far", "to").alias("_far"))
            if after.where("_far <> to").isEmpty():
                break
            up = after.select("x", F.col("_far").alias("to"))
        moved = written(up.join(picked.select("x", "pass"), "x").select(F.col("x").alias("group"), F.col("to").alias("_new"), "pass"), "moved")
        found = found.join(moved, "group", "left").select("basin", F.coalesce("_new", "group").alias("group"), F.greatest("level", F.coalesce("pass", F.col("level"))).alias("level"))
        found = written(found, "levels")
        for end in ("basin", "other"):
            edges = edges.join(moved.select(F.col("group").alias(end), "_new"), end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
        edges = edges.where("basin <> other").groupBy(F.least("basin", "other").alias("basin"), F.greatest("basin", "other").alias("other")).agg(F.min("pass").alias("pass"))
        edges = written(edges, "passes")
    return found.select("basin", "level")


def filled(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """row, col, height, filled: heights raised until water can leave the grid from every cell."""
    shape = "row long, col long, height double, filled double, basin long, other long, pass double"
    flooded = written(tiled(cells.select("row", "col", F.col("height").cast("double").alias("height")), tile, _flooded(tile), shape), "flooded")
    graph = flooded.where("other IS NOT NULL").select("basin", "other", "pass")
    rows = flooded.where("other IS NULL").join(levels(graph), "basin", "left")
    return rows.select("row", "col", "height", F.greatest("filled", "level").alias("filled"))


# --- directions


def _directed(tile: int) -> Callable[[pd.DataFrame, int, int], pd.DataFrame]:
    """Directions as far as distances on flats are known; ``told`` marks cells whose distance is new to other tiles."""
    codes, length = np.array(list(D8)), np.array([np.hypot(*s) for s in _STEPS])[:, None, None]

    def work(frame: pd.DataFrame, top: int, left: int) -> pd.DataFrame:
        side = tile + 2
        if frame.empty:
            return pd.DataFrame({n: [] for n in ("row", "col", "height", "filled", "away", "pointer", "slope", "told")})
        level, own = _grid(frame, "filled", top, left, side), _grid(frame, "_own", top, left, side, False, bool)
        height, away = _grid(frame, "height", top, left, side), _grid(frame, "away", top, left, side)
        before = away.copy()
        near = _around(level)
        with np.errstate(invalid="ignore"):
            drop = np.where(np.isnan(near), -np.inf, (level[1:-1, 1:-1] - near) / length)
            fall = np.nan_to_num(np.abs(height[1:-1, 1:-1] - _around(height)) / length).max(axis=0)
        steep, inner = drop.max(axis=0), own[1:-1, 1:-1]
        leaves = inner & ((steep > 0) | np.isnan(near).any(axis=0))
        away[1:-1, 1:-1][leaves] = 0
        queue = deque(sorted(((d, r, c) for r, c in zip(*np.nonzero(~np.isnan(away)), strict=True) for d in [away[r, c]]), key=lambda x: x[0]))
        later: deque = deque()
        while queue or later:  # two queues in order of distance: those that began, and those that were reached
            d, r, c = queue.popleft() if queue and (not later or queue[0][0] <= later[0][0]) else later.popleft()
            if d > away[r, c]:
                continue
            for dr, dc in _STEPS:
                x, y = r + dr, c + dc
                if 0 <= x < side and 0 <= y < side and own[x, y] and level[x, y] == level[r, c] and not away[x, y] <= d + 1:
                    away[x, y] = d + 1
                    later.append((d + 1, x, y))
        downhill = np.where(steep > 0, codes[drop.argmax(axis=0)], 0)
        back = np.where(near == level[1:-1, 1:-1], _around(away), np.inf)
        back = np.where(np.isnan(back), np.inf, back)
        over = np.where(back.min(axis=0) < away[1:-1, 1:-1], codes[back.argmin(axis=0)], 0)
        pointer = np.zeros(own.shape, int)
        pointer[1:-1, 1:-1] = np.where(steep > 0, downhill, np.where(leaves, 0, over))
        slope = np.zeros(own.shape)
        slope[1:-1, 1:-1] = fall / CELL
        edge = own.copy()
        edge[2:-2, 2:-2] = False
        told = edge & ~np.isnan(away) & ~(before == away)
        rows, cols = np.nonzero(own)
        return pd.DataFrame({"row": rows + top, "col": cols + left, "height": height[own], "filled": level[own], "away": away[own], "pointer": pointer[own], "slope": slope[own], "told": told[own]})

    return work


def directed(levelled: DataFrame, tile: int = TILE) -> DataFrame:
    """row, col, height, filled, pointer, slope. ``pointer`` is a D8 code, 0 where water leaves the grid; ``slope`` is the
    steepest rise or fall to a neighbour, of the heights as they were."""
    shape = "row long, col long, height double, filled double, away double, pointer int, slope double, told boolean"
    now = levelled.withColumn("away", F.lit(None).cast("double"))
    while True:
        now = written(tiled(now.select("row", "col", "height", "filled", "away"), tile, _directed(tile), shape), "directed")
        if now.where("told").isEmpty():
            return now.select("row", "col", "height", "filled", "pointer", "slope")


# --- streams


def _ordered(tile: int) -> Callable[[pd.DataFrame, int, int], pd.DataFrame]:
    def work(frame: pd.DataFrame, top: int, left: int) -> pd.DataFrame:
        if frame.empty:
            return pd.DataFrame({n: [] for n in ("row", "col", "pointer", "order", "told")})
        cells = list(zip(frame["row"].tolist(), frame["col"].tolist(), frame["pointer"].tolist(), frame["order"].tolist(), frame["_own"].tolist(), strict=True))
        order = {(r, c): o for r, c, _, o, _ in cells if o == o and o is not None}
        own = {(r, c): p for r, c, p, _, mine in cells if mine}
        inflow: dict[tuple[int, int], list[tuple[int, int]]] = {x: [] for x in own}
        down = {}
        for r, c, p, _, _ in cells:
            if p in D8:
                to = (r + D8[p][0], c + D8[p][1])
                down[(r, c)] = to
                if to in inflow:
                    inflow[to].append((r, c))
        waiting = {x: sum(y not in order for y in ys) for x, ys in inflow.items() if x not in order}
        ready, told = deque(x for x, n in waiting.items() if n == 0), set()
        while ready:
            x = ready.popleft()
            above = sorted((order[y] for y in inflow[x]), reverse=True)
            order[x] = 1 if not above else above[0] + (len(above) > 1 and above[0] == above[1])
            told.add(x)
            to = down.get(x)
            if to in waiting and to not in order:
                waiting[to] -= 1
                if waiting[to] == 0:
                    ready.append(to)
        rows = [(r, c, p, order.get((r, c), np.nan), (r, c) in told) for (r, c), p in own.items()]
        return pd.DataFrame(rows, columns=["row", "col", "pointer", "order", "told"])

    return work


def strahler(streams: DataFrame, tile: int = TILE) -> DataFrame:
    """row, col, order of stream cells (row, col, pointer): one at a source, one more where two of the highest meet."""
    now = streams.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "pointer", F.lit(None).cast("double").alias("order"))
    while True:
        now = written(tiled(now, tile, _ordered(tile), "row long, col long, pointer int, order double, told boolean"), "orders")
        if now.where("order IS NULL").isEmpty():
            return now.select("row", "col", F.col("order").cast("int").alias("order"))
        if now.where("told").isEmpty():
            raise ValueError("the pointers run in a circle")
        now = now.drop("told")


def hydrology(cells: DataFrame, threshold: int, tile: int = TILE) -> DataFrame:
    """row, col, height, filled, pointer, slope, flow, order: ``flow`` counts the cells that drain through one, itself
    included; ``order`` is its stream order, 0 where flow is below ``threshold``.

    A null height is no cell; of a cell given twice the lower height counts. An empty grid gives an empty result.
    """
    cells = cells.where("height IS NOT NULL").groupBy(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).agg(F.min(F.col("height").cast("double")).alias("height"))
    now = directed(filled(cells, tile), tile)
    flow = accumulate(now).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "flow")
    now = written(now.join(flow, ["row", "col"]), "flow")
    orders = strahler(now.where(F.col("flow") >= threshold), tile)
    return now.join(orders, ["row", "col"], "left").withColumn("order", F.coalesce("order", F.lit(0)))


def terrain_side(spark, d) -> int:
    """About eight lines a cell: the grid grows with the table."""
    return max(2, int((a.read(spark, d, "lineitem").count() / 8) ** 0.5))


def terrain(spark, d) -> DataFrame:
    """A height grid in metres from the table's lines: a tilt, and what the lines add to it."""
    side = terrain_side(spark, d)
    rows = a.read(spark, d, "lineitem").select((F.col("l_orderkey") % side).alias("row"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % side).alias("col"), "l_partkey")
    rough = rows.groupBy("row", "col").agg(F.min(F.col("l_partkey") % 199).alias("_rough"))
    return rough.select("row", "col", (F.col("_rough") / 10 + (F.col("row") + F.col("col")) * 0.25).alias("height"))


@query("rst_06")
def hydrology_chain(spark, d) -> DataFrame:
    """The whole chain over the terrain; tests hold it against plain floods of small grids."""
    return hydrology(terrain(spark, d), threshold=20)
