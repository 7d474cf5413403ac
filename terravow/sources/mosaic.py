"""Elevation tiles joined to one surface and laid on another grid, bilinearly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The wanted grid's step in source cells, and where its first centre lies, as whole parts of FIFTHS.
FIFTHS, STEP, FIRST = 5, 4, 2
LEAST_COVERAGE = 0.99


def mosaic(tiles: DataFrame) -> DataFrame:
    """row, col, height of (tile, row, col, height): where tiles overlap, the first tile that has a height counts."""
    held = tiles.where("height IS NOT NULL")
    return held.groupBy("row", "col").agg(F.min_by("height", "tile").alias("height"))


def wanted(spark, rows: int, cols: int) -> DataFrame:
    """r, c of every cell of the wanted grid over an extent of rows times cols source cells."""
    down, over = (max(0, ((n - 1) * FIFTHS - FIRST) // STEP + 1) for n in (rows, cols))
    return spark.range(down * over).select(F.expr(f"id DIV {max(over, 1)}").alias("r"), (F.col("id") % max(over, 1)).alias("c"))


def resampled(surface: DataFrame, grid: DataFrame) -> DataFrame:
    """r, c, height of the wanted cells that have any of the up to four source cells around their centre.

    A source cell weighs by how near it is on each axis; weights of missing ones go to the others. Each wanted cell asks
    for the cells around it by their place, so tiles need no frame: what lies beyond an edge is met by the join. With
    whole heights all sums are whole, so their order does not matter.
    """
    y, x = (F.col(c) * STEP + FIRST for c in ("r", "c"))
    near = [F.struct((F.floor(y / FIFTHS) + i).alias("row"), (F.floor(x / FIFTHS) + j).alias("col"), ((y % FIFTHS if i else FIFTHS - y % FIFTHS) * (x % FIFTHS if j else FIFTHS - x % FIFTHS)).alias("weight")) for i in (0, 1) for j in (0, 1)]
    asked = grid.select("r", "c", F.inline(F.array(*near))).where("weight > 0")
    met = asked.join(surface.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "height"), ["row", "col"])
    return met.groupBy("r", "c").agg((F.sum(F.col("weight") * F.col("height")) / F.sum("weight").cast("double")).alias("height"))


def reprojected(tiles: DataFrame, rows: int, cols: int) -> DataFrame:
    """r, c, height, coverage, usable: the tiles on the wanted grid over the wanted extent, and whether enough of it is
    covered. Cells without a height are not there; a surface with too many of them is marked, not shown as sound."""
    grid = wanted(tiles.sparkSession, rows, cols)
    found = resampled(mosaic(tiles), grid)
    share = found.agg(F.count(F.lit(1)).alias("_n")).join(grid.agg(F.count(F.lit(1)).alias("_all")))  # one row
    share = share.select((F.col("_n") / F.nullif(F.col("_all"), F.lit(0))).alias("coverage"))
    return found.join(F.broadcast(share)).withColumn("usable", F.col("coverage") >= LEAST_COVERAGE)
