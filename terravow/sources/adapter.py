"""The driver tables as evidence relations.

Every relation is a projection by integer arithmetic, written so that the same text is valid in Spark SQL and in the
comparing engine: each rule below is one scalar expression, used by the DataFrames here and by the SQL in
``terravow.plans.oracle``. Divisions come last and by doubles, so both engines round alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v

_FACTORS = {"terrain": (31, 17, 7), "satellite": (13, 29, 11), "temporal": (7, 41, 3), "photo": (19, 5, 23), "control": (11, 37, 13), "context": (3, 43, 19)}

CLAIM = {
    "claim_id": "o_orderkey",
    "district_lgd": "CAST(c_nationkey AS {text})",
    "asserted_date": "CAST(o_orderdate AS DATE)",
    "lon": "73e0 + (o_orderkey * 37 % 10000) / 1e4",
    "lat": "18e0 + (o_orderkey * 53 % 10000) / 1e4",
    "uncertainty_m": "1e1 + o_orderkey % 40",
    "detectability": "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'pending' WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'passed' END",
}
#: Of one line: agreement, availability and scale of each family; quality; gates.
INPUT = {
    **{f"{f}_agreement": f"((l_partkey * {a} + l_suppkey * {b} + version * {c}) % 201 - 100) / 1e2" for f, (a, b, c) in _FACTORS.items()},
    "terrain_agreement": "CASE WHEN l_partkey % 6 = 0 THEN -1e0 ELSE ((l_partkey * 31 + l_suppkey * 17 + version * 7) % 201 - 100) / 1e2 END",
    **{f"{f}_available": f"(l_partkey + l_suppkey * {a} + version) % 7 <> {i} AND l_partkey % 23 <> 0" for i, (f, (a, _, _)) in enumerate(_FACTORS.items())},
    **{f"{f}_cluster": f"(l_suppkey + {c}) % 3 = 0" for f, (_, _, c) in _FACTORS.items()},
    "escalated": "l_orderkey % 2 = 0",
    "metadata_integrity": "(l_partkey % 101) / 1e2",
    "data_sufficiency": "((l_suppkey * 7 + version * 13) % 101) / 1e2",
    "n_excluded": "CAST(l_suppkey % 3 AS INT)",
    "n_alternatives": "CAST(l_suppkey % 3 + l_partkey % 2 AS INT)",
    "n_limitations": "CAST(l_linenumber % 2 AS INT)",
    "scene_scale": "CASE l_partkey % 4 WHEN 0 THEN 'close_up' WHEN 1 THEN 'unknown' ELSE 'site' END",
    "provenance": "CASE WHEN l_suppkey % 4 = 0 THEN 'golden case' WHEN l_suppkey % 4 = 1 THEN NULL ELSE 'HLS S30 composite' END",
}
VERSION_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
WORK = {
    "intervention_id": "p_partkey",
    "unique_id": "concat('W-', lpad(CAST(p_partkey AS {text}), 6, '0'))",
    "type_index": "CAST(p_partkey % 18 AS INT)",
    "expected_footprint_m2": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 6e1 END",
    "project_id": "p_partkey % 40",
}
SIGNED = {"id": "o_orderkey", "user_id": "CAST(o_custkey % 17 AS {text})", "decision": "CASE o_orderkey % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'edit' ELSE 'reject' END", "reason": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('reason ', CAST(o_orderkey % 7 AS {text})) END", "corrected_level": "CASE WHEN o_orderkey % 3 = 1 THEN 'L2_corroborated' ELSE NULL END", "decided_on": "CAST(o_orderdate AS DATE)"}
AUDIT = {"id": "event_id", "at": "ts", "user_id": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id END", "action": "CASE event_type WHEN 'click' THEN 'claim.read' WHEN 'view' THEN 'verdict.read' WHEN 'signup' THEN 'auth.login' WHEN 'purchase' THEN 'verdict.adjudicate' ELSE 'auth.login_failed' END", "entity": "CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'claim' ELSE 'verdict' END", "entity_id": "CASE WHEN event_id % 10 = 0 THEN 'x-17' ELSE CAST((event_id * 7 % 1500) * 100 + 1 AS {text}) END", "payload": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE props END"}
#: Seasonal observations from shipments: one a claim, index, season, year.
CANDIDATE = {
    "control_id": "s_suppkey",
    "slope_deg": "(s_suppkey * 7 % 90) / 1e1",
    "elevation_m": "4e2 + s_suppkey * 13 % 160",
    "dist_to_stream_m": "1e0 * (s_suppkey * 29 % 300)",
    "strahler_order": "CAST(s_suppkey % 4 AS INT)",
    "lulc_class": "CAST(s_suppkey % 2 AS INT)",
    "easting_m": "1e0 * (s_suppkey * 211 % 4000)",
    "northing_m": "1e0 * (s_suppkey * 97 % 3000)",
    "dist_to_nearest_intervention_m": "1e0 * (s_suppkey * 61 % 2000)",
    "inside_command_buffer": "s_suppkey % 19 = 0",
    "data_sufficiency": "(50 + s_suppkey * 3 % 50) / 1e2",
    "delta": "((s_suppkey * 17) % 41 - 20) / 2e2",
}
PIXEL = {
    "scene_id": "l_suppkey % 6",
    "row": "CAST(l_orderkey % 40 AS INT)",
    "col": "CAST(l_partkey % 40 AS INT)",
    "red": "CASE WHEN l_partkey % 17 = 0 THEN -9999 ELSE CAST(l_partkey * 37 % 4000 AS INT) END",
    "nir": "CAST(l_suppkey * 91 % 6000 AS INT)",
    "green": "CAST((l_partkey + l_suppkey) * 53 % 3000 AS INT)",
    "blue": "CAST((l_partkey * 3 + l_orderkey) % 2500 AS INT)",
    "swir1": "CASE WHEN l_orderkey % 29 = 0 THEN -9999 ELSE CAST(l_orderkey * 17 % 5000 AS INT) END",
    "fmask": "CASE WHEN l_orderkey % 31 = 0 THEN 255 ELSE CAST(l_orderkey * 11 % 250 AS INT) END",
}


def rules(rule: dict[str, str], text: str = "STRING") -> list[str]:
    return [f"{expression.replace('{text}', text)} AS {name}" for name, expression in rule.items()]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interventions(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.broadcast(v.works(spark).select("type_index", "type"))  # 18 rows
    return read(spark, d, "part").selectExpr(*rules(WORK)).join(kinds, "type_index").drop("type_index")


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims; the structure claimed is one of the parts, by key."""
    orders = read(spark, d, "orders").join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    many = read(spark, d, "part").agg(F.count(F.lit(1)).alias("_parts"))  # one row
    return orders.join(F.broadcast(many)).selectExpr(*rules(CLAIM), "o_orderkey % _parts AS intervention_id")


def lines(spark: SparkSession, d: str, only_newest: bool = False) -> DataFrame:
    """Lines with the version of the verdict that each stands for; all of an order's, or the last."""
    rows = read(spark, d, "lineitem")
    if only_newest:
        last = Window.partitionBy("l_orderkey").orderBy(*(F.desc(c) for c in VERSION_ORDER))
        of = rows.withColumns({"_nth": F.row_number().over(last), "version": F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))})
        return of.where("_nth = 1").drop("_nth")
    order = Window.partitionBy("l_orderkey").orderBy(*VERSION_ORDER)
    return rows.withColumn("version", F.row_number().over(order).cast("long"))


def verdict_inputs(spark: SparkSession, d: str, only_newest: bool = False) -> DataFrame:
    """The bundles of all versions, or of each claim's newest.

    Claims meet their works first: the lines, and the wide rows made of them, are then shuffled by claim alone, once.
    """
    rows = lines(spark, d, only_newest).selectExpr("l_orderkey AS claim_id", "version", *rules(INPUT))
    about = claims(spark, d).select("claim_id", "intervention_id", "district_lgd", "detectability")
    kinds = interventions(spark, d).select("intervention_id", "type", "unique_id", "expected_footprint_m2")
    return rows.join(about.join(kinds, "intervention_id"), "claim_id").withColumn("detectability_passed", F.coalesce("detectability", F.lit("failed")) == "passed")


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every version's verdict, as the engine finds it; ids and status."""
    from ..operators.engine import reconcile

    newest = F.max("version").over(Window.partitionBy("claim_id"))
    signed = F.col("claim_id") % 4 == 0
    status = F.when(F.col("version") == newest, F.when(signed, "adjudicated").otherwise("pending")).otherwise(F.when(signed & (F.col("version") == 1), "adjudicated").otherwise("superseded"))
    return reconcile(verdict_inputs(spark, d)).withColumn("verdict_id", F.col("claim_id") * 100 + F.col("version")).withColumn("status", status)


def newest_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The newest verdict of each claim: older versions leave before anything is joined or judged.

    The window above the verdicts shuffles nothing, as rows already lie by claim. It keeps later filters on a level
    from being pushed below the engine, where its whole expression would be repeated for each use of the level.
    """
    from ..operators.engine import reconcile

    status = F.when(F.col("claim_id") % 4 == 0, "adjudicated").otherwise("pending")
    return newest(reconcile(verdict_inputs(spark, d, True))).withColumn("verdict_id", F.col("claim_id") * 100 + F.col("version")).withColumn("status", status)


def adjudications(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").where("o_orderkey % 4 = 0 OR o_orderkey % 50 = 1").selectExpr(*rules(SIGNED), "o_orderkey * 100 + 1 AS verdict_id")


def audit(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").selectExpr(*rules(AUDIT))


def users(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").selectExpr("c_custkey AS user_id", "concat('user', CAST(c_custkey AS STRING)) AS username", "CASE c_custkey % 6 WHEN 0 THEN 'WDT' WHEN 1 THEN 'PIA' WHEN 2 THEN 'WCDC' WHEN 3 THEN 'SLNA' WHEN 4 THEN 'DOLR_ADMIN' ELSE 'READONLY' END AS role", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS STRING) END AS scope_district", "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'state' END AS scope_state")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """One row a claim and family: the last write wins, which here is the newest version's."""
    rows = verdict_inputs(spark, d, True)
    parts = [F.struct(F.lit(f).alias("family"), F.round(F.col(f"{f}_agreement").cast("decimal(10,4)"), 3).cast("decimal(4,3)").alias("agreement"), F.col(f"{f}_available").alias("available"), F.col(f"{f}_cluster").alias("cluster_scale")) for f in v.FAMILIES]
    return rows.select("claim_id", "district_lgd", F.inline(F.array(*parts)))  # the bundles are made once, not for each family


def newest(rows: DataFrame, key: str = "claim_id") -> DataFrame:
    """The newest version of each key. Whatever else is asked of verdicts is asked of these."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version")))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Seasonal observations from the ship dates of each part's lines: claim = part."""
    from ..functions.scalars import season, season_year

    rows = read(spark, d, "lineitem").select(
        F.col("l_partkey").alias("claim_id"), F.expr("CASE WHEN l_suppkey % 2 = 0 THEN 'NDVI' ELSE 'MNDWI' END").alias("index_name"), season(F.to_date("l_shipdate")).alias("season"), season_year(F.to_date("l_shipdate")).alias("year"), "l_discount", "l_tax", "l_quantity")
    return rows.groupBy("claim_id", "index_name", "season", "year").agg(
        (F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.lit(100.0) / F.count(F.lit(1)) * 4 - 0.2).alias("value"),
        (F.max(F.round(F.col("l_tax") * 100).cast("long")) / F.lit(10.0)).alias("data_sufficiency"),
        F.count(F.lit(1)).alias("n_scenes"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").selectExpr(*rules(CANDIDATE))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels in long form; where a scene has a place twice, the smallest values stand."""
    rows = read(spark, d, "lineitem").selectExpr(*rules(PIXEL))
    return rows.groupBy("scene_id", "row", "col").agg(*(F.min(c).alias(c) for c in ("red", "nir", "green", "blue", "swir1", "fmask")))


def phash(spark: SparkSession, d: str) -> DataFrame:
    """64-bit perceptual hashes: a bit is set where an element of the vector exceeds the vector's median."""
    from ..functions.scalars import median_bits

    return read(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.expr("CAST(vec_id % 5 AS STRING)").alias("district_lgd"), median_bits("embedding").alias("phash"))
