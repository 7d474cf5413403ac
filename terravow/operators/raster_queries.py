"""Rasters in long form: masks, indices, composites, zonal and disk statistics, drainage, tile cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.queries import REFLECTED, _nd, indices, reflected
from ..functions.scalars import stored
from ..functions.storage import written
from ..plans.oracle import sql
from ..plans.registry import query
from ..sources import adapter as a
from .quantiles import exact_quantiles

FILL = 255
EXCLUDED = 2 | 4 | 8 | 16  # cloud, beside cloud, cloud shadow, snow
_CLEAR = "(fmask <> 255 AND (fmask & 30) = 0)"
count = lambda: F.count(F.lit(1))


def clear(fmask=None, high_aerosol: bool = False):
    """Usable pixels. High aerosol is not excluded unless asked for."""
    fmask = F.col("fmask") if fmask is None else fmask
    keep = (fmask != FILL) & (fmask.bitwiseAND(F.lit(EXCLUDED)) == 0)
    return keep & (fmask.bitwiseAND(F.lit(192)) != 192) if high_aerosol else keep


@query("rst_01", sql(f"SELECT scene_id, row, col, {_CLEAR} AS clear, (fmask & 32) <> 0 AND fmask <> 255 AS water FROM fx_pixels"))
def masks(spark, d):
    f = F.col("fmask")
    return a.pixels(spark, d).select("scene_id", "row", "col", clear().alias("clear"), ((f.bitwiseAND(F.lit(32)) != 0) & (f != FILL)).alias("water"))


@query("rst_02", sql(f"SELECT scene_id, row, col, CASE WHEN {_CLEAR} THEN {_nd('nir', 'red')} END AS ndvi FROM reflected", reflected=REFLECTED))
def masked(spark, d):
    return reflected(spark, d).select("scene_id", "row", "col", F.when(clear(), indices()["ndvi"]).alias("ndvi"))


def scenes(spark, d) -> DataFrame:
    return reflected(spark, d).select("scene_id", "row", "col", F.when(clear(), indices()["ndvi"]).alias("ndvi"), F.when(clear(), indices()["mndwi"]).alias("mndwi"))


SCENES = f"SELECT scene_id, row, col, CASE WHEN {_CLEAR} THEN {_nd('nir', 'red')} END AS ndvi, CASE WHEN {_CLEAR} THEN {_nd('green', 'swir1')} END AS mndwi FROM reflected"


@query("rst_03", sql("SELECT * FROM scenes", scenes=SCENES, reflected=REFLECTED))
def scene_indices(spark, d):
    return scenes(spark, d)


def composite(rows: DataFrame) -> DataFrame:
    """Median of each place over the scenes that see it; null where none does."""
    return rows.groupBy("row", "col").agg(F.percentile("ndvi", F.lit(0.5)).alias("ndvi"), F.count("ndvi").alias("n_scenes"))


_COMPOSITE = "SELECT row, col, quantile_cont(ndvi, 0.5) AS ndvi, count(ndvi) AS n_scenes FROM scenes GROUP BY ALL"
_ALL = {"composite": _COMPOSITE, "scenes": SCENES, "reflected": REFLECTED}


@query("agg_22", sql("SELECT * FROM composite", **_ALL))
def median_composite(spark, d):
    return composite(scenes(spark, d))


@query("agg_23", sql("SELECT row // 10 AS zone, min(ndvi) AS least, quantile_cont(ndvi, 0.5) AS median, max(ndvi) AS most, floor(avg(CAST(floor(ndvi * 1e6) AS BIGINT)) + 0.5e0) AS mean_ppm, count(ndvi) / CAST(count(*) AS DOUBLE) AS valid_fraction, count(ndvi) AS n_valid FROM composite GROUP BY 1", **_ALL))
def zonal(spark, d):
    """Statistics of each zone; a zone without a valid pixel is kept."""
    rows = written(composite(scenes(spark, d)).select(F.floor(F.col("row") / 10).cast("int").alias("zone"), "ndvi"), "zones")
    medians = exact_quantiles(rows, ["zone"], "ndvi", {"median": 0.5}).select("zone", "median")
    sums = rows.groupBy("zone").agg(F.min("ndvi").alias("least"), F.max("ndvi").alias("most"), F.floor(F.avg(F.floor(F.col("ndvi") * 1e6)) + 0.5).cast("double").alias("mean_ppm"), (F.count("ndvi") / count().cast("double")).alias("valid_fraction"), F.count("ndvi").alias("n_valid"))
    return sums.join(medians, "zone", "left")


@query("agg_24", sql("SELECT scene_id, count(ndvi) / CAST(count(*) AS DOUBLE) AS valid_fraction FROM scenes GROUP BY 1", **_ALL))
def valid_fraction(spark, d):
    return scenes(spark, d).groupBy("scene_id").agg((F.count("ndvi") / count().cast("double")).alias("valid_fraction"))


_FLAGS = {"cloud_px": 2, "adjacent_px": 4, "shadow_px": 8, "snow_px": 16, "water_px": 32}


@query("agg_25", sql("SELECT scene_id, count(*) AS total_px, count(*) FILTER (WHERE fmask = 255) AS fill_px, " + ", ".join(f"count(*) FILTER (WHERE fmask <> 255 AND (fmask & {b}) <> 0) AS {n}" for n, b in _FLAGS.items()) + f", count(*) FILTER (WHERE fmask <> 255 AND (fmask & 192) = 192) AS high_aerosol_px, count(*) FILTER (WHERE {_CLEAR}) AS usable_px, count(*) FILTER (WHERE {_CLEAR}) / CAST(nullif(count(*) FILTER (WHERE fmask <> 255), 0) AS DOUBLE) AS usable_fraction FROM fx_pixels GROUP BY 1"))
def accounting(spark, d):
    """Nine pixel counters of a scene; the usable fraction leaves fill out of its denominator."""
    f = F.col("fmask")
    seen = f != FILL
    n = lambda c: F.count(F.when(c, 1))
    return a.pixels(spark, d).groupBy("scene_id").agg(count().alias("total_px"), n(~seen).alias("fill_px"), *(n(seen & (f.bitwiseAND(F.lit(b)) != 0)).alias(name) for name, b in _FLAGS.items()), n(seen & (f.bitwiseAND(F.lit(192)) == 192)).alias("high_aerosol_px"), n(clear()).alias("usable_px"), F.try_divide(n(clear()).cast("double"), n(seen).cast("double")).alias("usable_fraction"))


_SITES = [(0, 10, 10), (1, 25, 30), (2, 39, 0)]


def sites(spark) -> DataFrame:
    return spark.createDataFrame(_SITES, "site int, r int, c int")


_SITES_SQL = "SELECT * FROM (VALUES " + ", ".join(map(str, _SITES)) + ") AS t(site, r, c)"


@query("agg_26", sql("SELECT site, floor(avg(CAST(floor(ndvi * 1e6) AS BIGINT)) + 0.5e0) AS mean_ppm, count(ndvi) AS n FROM sites LEFT JOIN composite ON row BETWEEN r - 2 AND r + 2 AND col BETWEEN c - 2 AND c + 2 GROUP BY 1", sites=_SITES_SQL, **_ALL))
def box_means(spark, d):
    """Mean over the square around each site: offsets are exploded, so the join is by place."""
    offsets = F.sequence(F.lit(-2), F.lit(2))
    around = sites(spark).select("site", "r", F.explode(F.transform(offsets, lambda x: x + F.col("c"))).alias("col")).select("site", "col", F.explode(F.transform(offsets, lambda x: x + F.col("r"))).alias("row"))
    rows = F.broadcast(around).join(composite(scenes(spark, d)), ["row", "col"], "left")
    return rows.groupBy("site").agg(F.floor(F.avg(F.floor(F.col("ndvi") * 1e6)) + 0.5).cast("double").alias("mean_ppm"), F.count("ndvi").alias("n"))


def disk(rows: DataFrame, places: DataFrame, radius: int) -> DataFrame:
    """Places within a radius of each site, by an offset table of fixed size."""
    offsets = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    table = rows.sparkSession.createDataFrame(offsets, "dr int, dc int")
    around = places.join(F.broadcast(table)).select("site", (F.col("r") + F.col("dr")).alias("row"), (F.col("c") + F.col("dc")).alias("col"))
    return F.broadcast(around).join(rows, ["row", "col"], "left")


@query("agg_27", sql("SELECT site, min(ndvi) AS least, quantile_cont(ndvi, 0.5) AS median, max(ndvi) AS most FROM sites LEFT JOIN composite ON (row - r) * (row - r) + (col - c) * (col - c) <= 9 GROUP BY 1", sites=_SITES_SQL, **_ALL))
def disk_statistics(spark, d):
    rows = disk(composite(scenes(spark, d)), sites(spark), 3)
    return rows.groupBy("site").agg(F.min("ndvi").alias("least"), F.percentile("ndvi", F.lit(0.5)).alias("median"), F.max("ndvi").alias("most"))


_THRESHOLDS = (200, 500, 1000, 2000, 3000)


def density_sweep(rows: DataFrame, thresholds=_THRESHOLDS, cell_m: float = 30.0, target: float = 6.0) -> DataFrame:
    """Drainage density by flow threshold, in km of stream a square km, and the distance from the target."""
    table = rows.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold int")
    one = rows.agg(*(F.count(F.when(F.col("flow") >= t, 1)).alias(f"_{t}") for t in thresholds), count().alias("_n"))
    found = table.join(F.broadcast(one))
    cells = F.coalesce(*(F.when(F.col("threshold") == t, F.col(f"_{t}")) for t in thresholds))
    density = cells * cell_m / 1000.0 / (F.col("_n") * cell_m * cell_m / 1e6)
    return found.select("threshold", cells.alias("cells"), density.alias("density"), F.abs(density - target).alias("off"))


@query("agg_28", sql("SELECT threshold, cells, cells * 30e0 / 1e3 / (n * 30e0 * 30e0 / 1e6) AS density, abs(cells * 30e0 / 1e3 / (n * 30e0 * 30e0 / 1e6) - 6e0) AS off FROM (SELECT t.threshold, count(*) FILTER (WHERE swir1 >= t.threshold) AS cells, count(*) AS n FROM fx_pixels, (SELECT unnest([200, 500, 1000, 2000, 3000]) AS threshold) t GROUP BY 1)"))
def drainage_density(spark, d):
    return density_sweep(a.pixels(spark, d).withColumn("flow", F.col("swir1")))


@query("rst_08", sql("SELECT arg_min(threshold, off * 1e6 + threshold / 1e6) AS chosen FROM (SELECT threshold, abs(cells * 30e0 / 1e3 / (n * 30e0 * 30e0 / 1e6) - 6e0) AS off FROM (SELECT t.threshold, count(*) FILTER (WHERE swir1 >= t.threshold) AS cells, count(*) AS n FROM fx_pixels, (SELECT unnest([200, 500, 1000, 2000, 3000]) AS threshold) t GROUP BY 1))"))
def chosen_threshold(spark, d):
    """The threshold nearest the target."""
    return drainage_density(spark, d).agg(F.min_by("threshold", F.col("off") * 1e6 + F.col("threshold") / 1e6).alias("chosen"))


def neighbours(rows: DataFrame, value: str) -> DataFrame:
    """Each place with the values of its four neighbours: shifted copies joined by place."""
    for name, dr, dc in (("up", 1, 0), ("down", -1, 0), ("left", 0, 1), ("right", 0, -1)):
        moved = rows.select("scene_id", (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.col(value).alias(name))
        rows = rows.join(moved, ["scene_id", "row", "col"], "left")
    return rows


@query("agg_29", sql("SELECT x.scene_id, floor(var_pop(CAST(u.green + w.green + l.green + r.green - 4 * x.green AS DOUBLE)) + 0.5e0) AS blur FROM fx_pixels x JOIN fx_pixels u ON u.scene_id = x.scene_id AND u.row = x.row - 1 AND u.col = x.col JOIN fx_pixels w ON w.scene_id = x.scene_id AND w.row = x.row + 1 AND w.col = x.col JOIN fx_pixels l ON l.scene_id = x.scene_id AND l.row = x.row AND l.col = x.col - 1 JOIN fx_pixels r ON r.scene_id = x.scene_id AND r.row = x.row AND r.col = x.col + 1 GROUP BY 1"))
def blur(spark, d):
    """Population variance of the Laplacian over places with four neighbours."""
    rows = neighbours(a.pixels(spark, d).select("scene_id", "row", "col", "green"), "green")
    laplacian = F.col("up") + F.col("down") + F.col("left") + F.col("right") - 4 * F.col("green")
    return rows.where(laplacian.isNotNull()).groupBy("scene_id").agg(F.floor(F.var_pop(laplacian.cast("double")) + 0.5).cast("double").alias("blur"))


@query("agg_30", sql("SELECT scene_id, count(*) FILTER (WHERE green <= 60) / CAST(count(*) AS DOUBLE) AS dark, count(*) FILTER (WHERE green >= 2940) / CAST(count(*) AS DOUBLE) AS bright, quantile_cont(green, 0.99) - quantile_cont(green, 0.01) AS spread FROM fx_pixels GROUP BY 1"))
def exposure(spark, d):
    g = F.col("green")
    share = lambda c: F.count(F.when(c, 1)) / count().cast("double")
    return a.pixels(spark, d).groupBy("scene_id").agg(share(g <= 60).alias("dark"), share(g >= 2940).alias("bright"), (F.percentile("green", F.lit(0.99)) - F.percentile("green", F.lit(0.01))).alias("spread"))


@query("rst_04", sql("SELECT site, floor(avg(CAST(floor(ndvi * 1e6) AS BIGINT)) + 0.5e0) AS mean_ppm, min(n_scenes) AS n_scenes FROM sites JOIN composite ON row BETWEEN r - 1 AND r + 1 AND col BETWEEN c - 1 AND c + 1 GROUP BY 1", sites=_SITES_SQL, **_ALL))
def series_entry(spark, d):
    """Site means of a season's composite."""
    offsets = F.sequence(F.lit(-1), F.lit(1))
    around = sites(spark).select("site", "r", F.explode(F.transform(offsets, lambda x: x + F.col("c"))).alias("col")).select("site", "col", F.explode(F.transform(offsets, lambda x: x + F.col("r"))).alias("row"))
    rows = composite(scenes(spark, d)).join(F.broadcast(around), ["row", "col"])
    return rows.groupBy("site").agg(F.floor(F.avg(F.floor(F.col("ndvi") * 1e6)) + 0.5).cast("double").alias("mean_ppm"), F.min("n_scenes").alias("n_scenes"))


@query("rst_05", sql("SELECT control_id, CAST(trunc((3000e0 - northing_m) / 30e0) AS INT) AS row, CAST(trunc(easting_m / 30e0) AS INT) AS col FROM fx_candidates"))
def addressing(spark, d):
    """Row from the top and column from the left, truncated."""
    c = F.col
    return a.candidates(spark, d).select("control_id", ((3000.0 - c("northing_m")) / 30.0).cast("int").alias("row"), (c("easting_m") / 30.0).cast("int").alias("col"))


@query("rst_07", sql("SELECT scene_id, row, col, CASE WHEN swir1 >= 1000 THEN 1 ELSE 0 END AS stream FROM fx_pixels"))
def stream_mask(spark, d):
    return a.pixels(spark, d).select("scene_id", "row", "col", F.when(F.col("swir1") >= 1000, 1).otherwise(0).alias("stream"))


@query("rst_09", sql("SELECT r AS row, c AS col FROM extent, unnest(generate_series(0, high, 12)) AS t(r), unnest(generate_series(0, wide, 12)) AS u(c)", extent="SELECT max(l_orderkey % 4001) AS high, max(l_partkey % 3001) AS wide FROM lineitem"))
def candidate_grid(spark, d):
    """Every twelfth cell over the extent of what the lines cover."""
    extent = a.read(spark, d, "lineitem").agg(F.max(F.col("l_orderkey") % 4001).alias("high"), F.max(F.col("l_partkey") % 3001).alias("wide"))
    grid = lambda high: F.explode(F.sequence(F.lit(0).cast("long"), F.col(high), F.lit(12).cast("long")))
    return extent.select("wide", grid("high").alias("row")).select("row", grid("wide").alias("col"))


@query("rst_10", "SELECT s_suppkey AS claim_id, k, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 10e0 + k END, floor(300e0 * cos(k * pi() / 4) * 1e3 + 0.5e0) / 1e3) AS x FROM supplier, (SELECT unnest(generate_series(0, 7)) AS k) t")
def control_positions(spark, d):
    """Positions from the terrain where there are any, else eight points on a ring."""
    rows = a.read(spark, d, "supplier").select(F.col("s_suppkey").alias("claim_id"), F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>")).alias("k"))
    measured = F.when(F.col("claim_id") % 3 == 0, F.col("claim_id") * 10.0 + F.col("k"))
    return rows.select("claim_id", "k", F.coalesce(measured, stored(300.0 * F.cos(F.col("k") * F.pi() / 4), 3)).alias("x"))


# D8 directions in the usual coding, clockwise from east: (row step, column step).
D8 = {1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1), 64: (-1, 0), 128: (-1, 1)}


def segments(cells: DataFrame) -> DataFrame:
    """Stream cells joined with the stream cell their pointer leads to."""
    step = lambda k: F.coalesce(*(F.when(F.col("pointer") == p, F.lit(s[k])) for p, s in D8.items()))
    here = cells.select(F.col("row").alias("from_row"), F.col("col").alias("from_col"), (F.col("row") + step(0)).alias("to_row"), (F.col("col") + step(1)).alias("to_col"), "order")
    there = cells.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"))
    return here.join(there, ["to_row", "to_col"]).select("from_row", "from_col", "to_row", "to_col", "order")


_CELLS = "SELECT row, col, CAST(1 << CAST(min(green) % 8 AS INT) AS INT) AS pointer, CAST(max(nir) % 4 + 1 AS INT) AS order FROM fx_pixels GROUP BY ALL HAVING max(swir1) >= 1500"
_CELLS = _CELLS.replace(" AS order ", ' AS "order" ')


def stream_cells(spark, d) -> DataFrame:
    rows = a.pixels(spark, d).groupBy("row", "col").agg(F.call_function("shiftleft", F.lit(1), (F.min("green") % 8).cast("int")).alias("pointer"), (F.max("nir") % 4 + 1).cast("int").alias("order"), F.max("swir1").alias("_flow"))
    return rows.where("_flow >= 1500").drop("_flow")


_steps = lambda k: "CASE pointer " + " ".join(f"WHEN {p} THEN {s[k]}" for p, s in D8.items()) + " END"
_SEGMENTS = f'SELECT x.row AS from_row, x.col AS from_col, y.row AS to_row, y.col AS to_col, x."order" FROM (SELECT *, row + {_steps(0)} AS tr, col + {_steps(1)} AS tc FROM cells) x JOIN cells y ON y.row = x.tr AND y.col = x.tc'


@query("joi_19", sql(_SEGMENTS, cells=_CELLS))
def downstream(spark, d):
    return segments(stream_cells(spark, d))


@query("rst_11", sql(f'SELECT "order", count(*) AS n FROM ({_SEGMENTS}) GROUP BY 1', cells=_CELLS))
def drainage_lines(spark, d):
    return downstream(spark, d).groupBy("order").agg(count().alias("n"))


@query("agg_34", sql("SELECT w.site, CAST(sum(t.bytes) AS BIGINT) AS bytes, count(*) AS tiles FROM (SELECT site, r * 30 AS top, c * 30 AS west FROM sites) w JOIN (SELECT row // 8 AS tr, col // 8 AS tc, sum(red + 10000) AS bytes FROM fx_pixels GROUP BY ALL) t ON t.tr * 240 < w.top + 300 AND (t.tr + 1) * 240 > w.top - 300 AND t.tc * 240 < w.west + 300 AND (t.tc + 1) * 240 > w.west - 300 GROUP BY 1", sites=_SITES_SQL))
def tile_cost(spark, d):
    """Bytes of the tiles that each window meets."""
    tiles = a.pixels(spark, d).groupBy(F.floor(F.col("row") / 8).alias("tr"), F.floor(F.col("col") / 8).alias("tc")).agg(F.sum(F.col("red") + 10000).alias("bytes"))
    w = sites(spark).select("site", (F.col("r") * 30).alias("top"), (F.col("c") * 30).alias("west"))
    meets = (F.col("tr") * 240 < F.col("top") + 300) & ((F.col("tr") + 1) * 240 > F.col("top") - 300) & (F.col("tc") * 240 < F.col("west") + 300) & ((F.col("tc") + 1) * 240 > F.col("west") - 300)
    return tiles.join(F.broadcast(w), meets).groupBy("site").agg(F.sum("bytes").alias("bytes"), count().alias("tiles"))


@query("rst_12", sql("SELECT site, tiles <= 30 AS within_budget FROM (SELECT w.site, count(*) AS tiles FROM (SELECT site, r * 30 AS top, c * 30 AS west FROM sites) w JOIN (SELECT DISTINCT row // 8 AS tr, col // 8 AS tc FROM fx_pixels) t ON t.tr * 240 < w.top + 300 AND (t.tr + 1) * 240 > w.top - 300 AND t.tc * 240 < w.west + 300 AND (t.tc + 1) * 240 > w.west - 300 GROUP BY 1)", sites=_SITES_SQL))
def within_budget(spark, d):
    return tile_cost(spark, d).select("site", (F.col("tiles") <= 30).alias("within_budget"))


def accumulate(cells: DataFrame, rounds: int | None = None) -> DataFrame:
    """Flow accumulation over D8 pointers: how many cells drain through each, itself included.

    Pointer doubling: after round k every cell knows how much reaches it from up to 2**k - 1 steps upstream and the
    cell 2**k steps downstream, so the rounds grow with the logarithm of the longest path. Each round is written.
    """
    from ..functions.storage import written

    step = lambda k: F.coalesce(*(F.when(F.col("pointer") == p, F.lit(s[k])) for p, s in D8.items()))
    key = lambda r, c: F.shiftleft(r.cast("long"), 31) + c + (1 << 30)
    now = written(cells.select(key(F.col("row"), F.col("col")).alias("cell"), key(F.col("row") + step(0), F.col("col") + step(1)).alias("down"), F.lit(1).cast("long").alias("flow")), "flow")
    exists = now.select(F.col("cell").alias("down"))
    now = now.join(exists.withColumn("_in", F.lit(True)), "down", "left").select("cell", F.when(F.col("_in"), F.col("down")).alias("down"), "flow")
    done = 0
    while rounds is None or done < rounds:
        now = written(now, "flow")
        if now.where("down IS NOT NULL").isEmpty():
            break
        inflow = now.where("down IS NOT NULL").groupBy(F.col("down").alias("cell")).agg(F.sum("flow").alias("_more"))
        jump = now.select(F.col("cell").alias("down"), F.col("down").alias("_next"))
        now = now.join(inflow, "cell", "left").join(jump, "down", "left").select("cell", F.col("_next").alias("down"), (F.col("flow") + F.coalesce("_more", F.lit(0))).alias("flow"))
        done += 1
        if done > 40:
            raise ValueError("the pointers run in a circle")
    return now.select(F.shiftright("cell", 31).cast("int").alias("row"), (F.col("cell").bitwiseAND(F.lit((1 << 31) - 1)) - (1 << 30)).cast("int").alias("col"), "flow")
