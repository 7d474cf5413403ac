"""Scans, file sources and sinks as queries. Sinks are round trips: written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import shared_path, written
from ..plans.oracle import sql
from ..plans.registry import query
from . import adapter as a
from .uploads import inspected

count = lambda: F.count(F.lit(1))


@query("src_01", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'")
def table_scan(spark, d) -> DataFrame:
    """A table scan; the filter and the two columns reach the reader."""
    return a.read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderstatus")


def json_lines(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as JSON and read again by a declared schema."""
    path = shared_path(df.sparkSession, tag)
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


@query("src_02", sql("SELECT level, count(*) AS n, count(*) AS n_counted FROM fx_verdicts GROUP BY 1"))
def transaction_scope(spark, d) -> DataFrame:
    """Verdicts and their counts written by a stream, both tables in one transaction a batch. Every batch fails once
    between the two tables and is run again; each row is there once, and the tables agree."""
    from ..functions.commits import Store
    from ..streaming.queries import as_stream, run_again

    store = Store(spark, shared_path(spark, "store"))
    failed: set[int] = set()

    def write(batch: DataFrame, number: int) -> None:
        with store.transaction(number) as scope:
            scope.write("verdicts", batch)
            if number not in failed:
                failed.add(number)
                raise RuntimeError("failed between two tables")
            scope.write("counts", batch.groupBy("level").agg(count().alias("n")))

    run_again(as_stream(a.verdicts(spark, d).select("claim_id", "version", "level"), 2), write)
    rows = store.read("verdicts", "claim_id long, version long, level string")
    sums = store.read("counts", "level string, n long").groupBy("level").agg(F.sum("n").alias("n_counted"))
    return rows.groupBy("level").agg(count().alias("n")).join(sums, "level")


@query("src_03", sql("SELECT claim_id, index_name, season, year, value FROM fx_observations"))
def json_artefact(spark, d) -> DataFrame:
    """Seasonal series documents, one object a line, exploded into observations."""
    docs = a.observations(spark, d).groupBy("claim_id").agg(F.collect_list(F.struct("index_name", "season", "year", "value")).alias("series"))
    return json_lines(docs, "series").select("claim_id", F.inline("series"))


@query("src_04", sql("SELECT id, action FROM fx_audit"))
def json_log(spark, d) -> DataFrame:
    """A probe log read by its schema; lines that do not fit would have nulls."""
    return json_lines(a.audit(spark, d).select("id", "action"), "log")


@query("src_05", sql("SELECT claim_id, level AS expected, floor(score * 1e4 + 0.5e0) / 1e4 AS anchor FROM fx_newest"))
def declared_cases(spark, d) -> DataFrame:
    """Cases as flat YAML text, one a claim, written as files and read back under an explicit schema."""
    rows = a.newest(a.verdicts(spark, d))
    anchor = (F.floor(F.col("score") * 1e4 + 0.5).cast("double") / 1e4).cast("string")
    case = F.concat(F.lit("# declared\ncase: "), F.col("claim_id").cast("string"), F.lit("\nexpected: "), F.col("level"), F.lit("\nanchor:  "), anchor, F.lit("\n"))
    held = written(rows.select(case.alias("text")), "cases")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\w+:"))
    pairs = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^\w+:", "")))))
    held = held.select(pairs.alias("case"))
    return held.select(F.col("case")["case"].cast("long").alias("claim_id"), F.col("case")["expected"].alias("expected"), F.col("case")["anchor"].cast("double").alias("anchor"))


@query("src_06", sql("SELECT season, year, scene FROM (SELECT *, row_number() OVER (PARTITION BY season, year ORDER BY cloud, scene) AS nth FROM catalogue WHERE cloud < 20) WHERE nth <= 4", catalogue="SELECT l_suppkey AS scene, CAST(year(l_shipdate) AS INT) AS year, CASE WHEN month(l_shipdate) BETWEEN 6 AND 10 THEN 'kharif' WHEN month(l_shipdate) BETWEEN 3 AND 5 THEN 'summer' ELSE 'rabi' END AS season, min(l_quantity) AS cloud FROM lineitem GROUP BY ALL"))
def scene_search(spark, d) -> DataFrame:
    """Catalogue search: bounded, under twenty percent cloud, the four clearest of each season."""
    from ..functions.scalars import season

    rows = a.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("scene"), F.year("l_shipdate").alias("year"), season("l_shipdate").alias("season")).agg(F.min("l_quantity").alias("cloud"))
    nth = F.row_number().over(Window.partitionBy("season", "year").orderBy("cloud", "scene"))
    return rows.where("cloud < 20").withColumn("_n", nth).where("_n <= 4").select("season", "year", "scene")


@query("src_07", sql("SELECT scene_id, CAST((row - 5) // 2 AS BIGINT) AS r, CAST((col - 5) // 2 AS BIGINT) AS c, arg_min(nir, row * 100 + col) AS nir FROM fx_pixels WHERE row BETWEEN 5 AND 24 AND col BETWEEN 5 AND 24 GROUP BY ALL"))
def band_window(spark, d) -> DataFrame:
    """A window of one band, placed on the target grid by nearest neighbour."""
    rows = a.pixels(spark, d).where("row BETWEEN 5 AND 24 AND col BETWEEN 5 AND 24")
    return rows.select("scene_id", F.floor((F.col("row") - 5) / 2).alias("r"), F.floor((F.col("col") - 5) / 2).alias("c"), "row", "col", "nir").groupBy("scene_id", "r", "c").agg(F.min_by("nir", F.struct("row", "col")).alias("nir"))


@query("src_08", sql("SELECT row // 8 AS tile_row, col // 8 AS tile_col, count(*) * 12 AS bytes FROM fx_pixels GROUP BY ALL"))
def tile_index(spark, d) -> DataFrame:
    rows = a.pixels(spark, d)
    return rows.groupBy(F.floor(F.col("row") / 8).cast("int").alias("tile_row"), F.floor(F.col("col") / 8).cast("int").alias("tile_col")).agg((count() * 12).alias("bytes"))


_SIDE = "SELECT CAST(floor(sqrt(count(*) / 8e0)) AS BIGINT) AS side FROM lineitem"
_HEIGHTS = "SELECT l_orderkey % side AS row, (l_partkey * 7 + l_suppkey) % side AS col, min(l_partkey % 199) * 10 + (any_value(l_orderkey % side) + any_value((l_partkey * 7 + l_suppkey) % side)) * 25 AS height FROM lineitem, extent GROUP BY 1, 2"
_SURFACE = "SELECT row, col, arg_min(height, tile) AS height FROM (SELECT 0 AS tile, row, col, height FROM heights, extent WHERE row <= side // 2 + 2 UNION ALL SELECT 1, row, col, height + 30 FROM heights, extent WHERE row >= side // 2 - 2) GROUP BY ALL"
_WANTED = "SELECT r, c, r * 4 + 2 AS y, c * 4 + 2 AS x FROM extent, unnest(generate_series(0, ((side - 1) * 5 - 2) // 4)) AS t(r), unnest(generate_series(0, ((side - 1) * 5 - 2) // 4)) AS u(c)"
_LAID = "SELECT r, c, CAST(sum(weight * height) AS BIGINT) / CAST(CAST(sum(weight) AS BIGINT) AS DOUBLE) AS height FROM (SELECT r, c, y // 5 + i AS row, x // 5 + j AS col, (CASE WHEN i = 1 THEN y % 5 ELSE 5 - y % 5 END) * (CASE WHEN j = 1 THEN x % 5 ELSE 5 - x % 5 END) AS weight FROM wanted, (VALUES (0), (1)) AS a(i), (VALUES (0), (1)) AS b(j)) JOIN surface USING (row, col) WHERE weight > 0 GROUP BY r, c"


@query("src_10", sql("SELECT r, c, height, coverage, coverage >= 0.99e0 AS usable FROM laid, (SELECT (SELECT count(*) FROM laid) / CAST((SELECT count(*) FROM wanted) AS DOUBLE) AS coverage)", extent=_SIDE, heights=_HEIGHTS, surface=_SURFACE, wanted=_WANTED, laid=_LAID))
def elevation_mosaic(spark, d) -> DataFrame:
    """Two overlapping tiles, in centimetres, as one surface on a finer grid; the share covered decides whether it may be used."""
    from ..operators.hydrology import terrain, terrain_side
    from .mosaic import reprojected

    side = terrain_side(spark, d)
    heights = written(terrain(spark, d).select("row", "col", F.round(F.col("height") * 100).cast("long").alias("height")), "heights")
    north = heights.where(F.col("row") <= side // 2 + 2).withColumn("tile", F.lit(0))
    south = heights.where(F.col("row") >= side // 2 - 2).withColumn("tile", F.lit(1)).withColumn("height", F.col("height") + 30)
    return reprojected(north.unionByName(south), side, side)


_TILES = "SELECT DISTINCT CAST(floor(lat) AS BIGINT) AS lat, CAST(floor(lon) AS BIGINT) AS lon FROM fx_claims"


@query("src_11", sql("SELECT 'N' || lpad(CAST(lat AS VARCHAR), 2, '0') || 'E' || lpad(CAST(lon AS VARCHAR), 3, '0') AS tile FROM tiles WHERE (lat + lon) % 3 <> 0", tiles=_TILES))
def missing_tiles(spark, d) -> DataFrame:
    """Tiles that the claims need and the store lacks; names are parsed back into their origin."""
    name = F.concat(F.lit("N"), F.lpad(F.col("lat").cast("string"), 2, "0"), F.lit("E"), F.lpad(F.col("lon").cast("string"), 3, "0"))
    needed = a.claims(spark, d).select(F.floor("lat").alias("lat"), F.floor("lon").alias("lon")).distinct()
    files = needed.where((F.col("lat") + F.col("lon")) % 3 == 0).select(F.lower(F.concat(name, F.lit(".hgt"))).alias("file"))
    part = lambda k: F.regexp_extract("file", r"(?i)^n(\d{2})e(\d{3})\.hgt$", k).cast("long")
    present = files.select(part(1).alias("lat"), part(2).alias("lon"))
    return needed.join(present, ["lat", "lon"], "left_anti").select(name.alias("tile"))


def planted_pictures(spark, d) -> DataFrame:
    """A file for each document: pictures of three kinds with their dimensions and camera fields by the id, a sound file
    that begins like one of them, a broken picture, and plain text; the document's text lies behind."""
    k = F.col("doc_id")
    number = lambda c, width: F.lpad(F.hex(c.cast("long")), 2 * width, "0")
    fixed = lambda x: F.lit(x.replace(" ", ""))
    wide, high = k % 4000 + 1, k % 3000 + 2
    model = F.when(k % 7 == 0, "      ").otherwise(F.concat(F.lit("Cam"), F.lpad((k % 1000).cast("string"), 3, "0")))
    taken = F.date_format(F.expr("TIMESTAMP_NTZ'2023-11-14 22:13:20' + make_dt_interval(0, 0, 0, doc_id * 1000)"), "yyyy:MM:dd HH:mm:ss")
    place = lambda whole: F.concat(number(whole, 4), fixed("00000001"), number(k % 60, 4), fixed("00000001"), number(k % 6000, 4), fixed("00000064"))
    tiff = F.concat(
        fixed("4D4D002A 00000008 0003  0110 0002 00000008 00000032  0132 0002 00000014 0000003A  8825 0004 00000001 0000004E  00000000"),
        F.hex(F.encode(model, "utf-8")), fixed("0000"), F.hex(F.encode(taken, "utf-8")), fixed("00"),
        fixed("0004  0001 0002 00000002"), F.when(k % 2 == 0, "4E000000").otherwise("53000000"), fixed("0002 0005 00000003 00000084  0003 0002 00000002"), fixed("45000000"), fixed("0004 0005 00000003 0000009C  00000000"),
        place(15 + k % 10), place(70 + k % 20),
    )
    jpeg = F.concat(fixed("FFD8 FFE1 00BC 457869660000"), tiff, fixed("FFC0 0011 08"), number(high, 2), number(wide, 2), fixed("03 012200 021101 031101 FFD9"))
    png = F.concat(fixed("89504E470D0A1A0A 0000000D 49484452"), number(wide, 4), number(high, 4), fixed("0806000000"))
    lossless = ((high - 1) * 16384 + wide - 1).cast("long")
    webp = F.concat(fixed("52494646 00000000 57454250 5650384C 00000000 2F"), *(number(F.shiftright(lossless, 8 * i).bitwiseAND(F.lit(255)), 1) for i in range(4)))
    sound = fixed("52494646 00000000 57415645 666D7420")
    cut = F.substring(jpeg, 1, 100)
    head = F.element_at(F.array(jpeg, png, webp, sound, cut, fixed("3C68746D6C3E")), (k % 6 + 1).cast("int"))
    content = F.concat(F.unhex(head), F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    return a.read(spark, d, "documents").select(k.cast("string").alias("name"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


@query("src_12", "SELECT CAST(doc_id AS VARCHAR) AS name, CASE doc_id % 6 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 4 THEN 'jpeg' END AS kind, CASE WHEN doc_id % 6 < 3 THEN CAST(doc_id % 4000 + 1 AS INT) END AS width, CASE WHEN doc_id % 6 < 3 THEN CAST(doc_id % 3000 + 2 AS INT) END AS height, CASE WHEN doc_id % 6 IN (3, 5) THEN 'no picture' WHEN doc_id % 6 = 4 THEN 'no dimensions' END AS problem FROM documents")
def sniffed(spark, d) -> DataFrame:
    """Kind of an upload by its bytes, never by its name, and its dimensions; refusals with their reason."""
    return inspected(planted_pictures(spark, d)).select("name", "kind", "width", "height", "problem")


_DMS = lambda whole: f"{whole} + (doc_id % 60) / 60e0 + (doc_id % 6000) / 1e2 / 36e2"


@query("src_13", f"SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 7 <> 0 THEN 'Cam' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') END AS model, strftime(make_timestamp((1700000000 + doc_id * 1000) * 1000000), '%Y-%m-%d %H:%M:%S') AS taken, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END * ({_DMS('(15 + doc_id % 10)')}) AS lat, {_DMS('(70 + doc_id % 20)')} AS lon FROM documents WHERE doc_id % 6 = 0")
def camera_fields(spark, d) -> DataFrame:
    """Device, time and place out of the picture directory of every sound JPEG; blanks are missing."""
    return inspected(planted_pictures(spark, d)).where("kind = 'jpeg' AND problem IS NULL").select("name", "model", "taken", "lat", "lon")


# --- sinks


@query("snk_01", sql("SELECT claim_id, 'field/' || district_lgd || '/' || claim_id AS key FROM fx_claims"))
def object_keys(spark, d) -> DataFrame:
    return a.claims(spark, d).select("claim_id", F.concat_ws("/", F.lit("field"), "district_lgd", F.col("claim_id").cast("string")).alias("key"))


@query("snk_02", sql("SELECT family, count(*) AS n, count(*) FILTER (WHERE available) AS n_available FROM fx_evidence GROUP BY 1"))
def append_evidence(spark, d) -> DataFrame:
    """Evidence rows appended and read back."""
    rows = written(a.evidence(spark, d), "evidence")
    return rows.groupBy("family").agg(count().alias("n"), F.count(F.when(F.col("available"), 1)).alias("n_available"))


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Last writer wins by key; among equal times the incoming row."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by), F.desc("_new")))
    return both.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_new")


@query("snk_03", sql("SELECT claim_id, max(version) AS version, arg_max(data_sufficiency, version) AS data_sufficiency FROM fx_inputs GROUP BY 1"))
def upsert(spark, d) -> DataFrame:
    rows = a.verdict_inputs(spark, d).select("claim_id", "version", "data_sufficiency")
    return upserted(rows.where("version % 2 = 1"), rows.where("version % 2 = 0"), ["claim_id"], "version")


@query("snk_04", sql("SELECT claim_id, version, CASE WHEN version < max(version) OVER (PARTITION BY claim_id) AND old <> 'adjudicated' THEN 'superseded' ELSE old END AS status FROM (SELECT *, CASE WHEN claim_id % 4 = 0 AND version = 1 THEN 'adjudicated' ELSE 'pending' END AS old FROM fx_inputs)"))
def supersede(spark, d) -> DataFrame:
    """Earlier versions are superseded, but never one that is adjudicated."""
    old = F.when((F.col("claim_id") % 4 == 0) & (F.col("version") == 1), "adjudicated").otherwise("pending")
    rows = a.verdict_inputs(spark, d).select("claim_id", "version", old.alias("old"))
    newer = F.max("version").over(Window.partitionBy("claim_id")) > F.col("version")
    return rows.select("claim_id", "version", F.when(newer & (F.col("old") != "adjudicated"), "superseded").otherwise(F.col("old")).alias("status"))


@query("snk_05", sql("SELECT intervention_id FROM fx_interventions"))
def insert_missing(spark, d) -> DataFrame:
    """Rows whose key exists already are not inserted again."""
    rows = a.interventions(spark, d).select("intervention_id")
    existing = rows.where("intervention_id % 3 = 0")
    return existing.unionByName(rows.join(existing, "intervention_id", "left_anti"))


@query("snk_07", sql("SELECT action, count(*) AS n, count(payload) AS n_redacted FROM fx_audit GROUP BY 1"))
def audit_append(spark, d) -> DataFrame:
    from ..functions.queries import redacted

    rows = a.audit(spark, d).select("action", F.to_json(redacted(F.from_json("payload", "map<string,string>"))).alias("payload"))
    rows = written(rows, "audit")
    return rows.groupBy("action").agg(count().alias("n"), F.count(F.when(F.contains("payload", F.lit("[redacted]")), 1)).alias("n_redacted"))


@query("snk_08", "SELECT event_id FROM events WHERE NOT (ts < TIMESTAMP '2024-01-08 00:00:00' AND event_type = 'signup')")
def pruned(spark, d) -> DataFrame:
    """Expired tokens leave; the moment is an argument."""
    return a.read(spark, d, "events").where("NOT (ts < TIMESTAMP_NTZ '2024-01-08 00:00:00' AND event_type = 'signup')").select("event_id")


@query("snk_10", sql("SELECT claim_id, unique_id FROM fx_claims JOIN fx_interventions USING (intervention_id)"))
def json_writer(spark, d) -> DataFrame:
    return json_lines(a.claims(spark, d).join(a.interventions(spark, d), "intervention_id").select("claim_id", "unique_id"), "features")
