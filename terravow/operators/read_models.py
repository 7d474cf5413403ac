"""Read models: what a page or a report shows, composed from the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..plans.oracle import sql
from ..plans.registry import query
from ..sources import adapter as a
from .relational import _COMBINED, _QUEUE, combinations, count, direction, measured, newest, provenance, queue, signed


@query("rm_01", sql("SELECT l.level, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS n, CAST(coalesce(sum(c.n) FILTER (WHERE measured), 0) AS BIGINT) AS n_measured, sum(c.sum_confidence) / 1e4 / sum(c.n) AS mean_confidence FROM fx_levels l LEFT JOIN combined c USING (level) GROUP BY 1", combined=_COMBINED))
def analytics(spark, d):
    """Levels, zero-filled, with means that are null where nothing is."""
    per = combinations(spark, d).groupBy("level").agg(F.sum("n").alias("_n"), F.sum(F.when(F.col("measured"), F.col("n"))).alias("_m"), F.sum("sum_confidence").alias("_c"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return v.levels(spark).join(per, "level", "left").select("level", zero("_n").alias("n"), zero("_m").alias("n_measured"), F.try_divide(F.col("_c") / F.lit(1e4), F.col("_n")).alias("mean_confidence"))


@query("rm_02", sql("SELECT claim_id, verdict_id, unique_id, type, district_lgd, level, label, action, position, adjudicated FROM queue", queue=_QUEUE))
def alerts(spark, d):
    """The ranked verification queue."""
    return queue(newest(spark, d), a.adjudications(spark, d)).select("claim_id", "verdict_id", "unique_id", "type", "district_lgd", "level", "label", "action", "position", "adjudicated")


@query("agg_14", sql("SELECT l.level, count(q.claim_id) AS n, count(q.claim_id) FILTER (WHERE NOT q.adjudicated) AS n_open FROM fx_levels l LEFT JOIN queue q USING (level) WHERE l.severity IS NOT NULL GROUP BY 1", queue=_QUEUE))
def alert_summary(spark, d):
    per = queue(newest(spark, d), a.adjudications(spark, d)).groupBy("level").agg(count().alias("_n"), F.count(F.when(~F.col("adjudicated"), 1)).alias("_o"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return v.levels(spark).where("severity IS NOT NULL").join(per, "level", "left").select("level", zero("_n").alias("n"), zero("_o").alias("n_open"))


@query("rm_03", sql("SELECT c.claim_id, i.unique_id, v.level, v.label, CASE WHEN c.intervention_id % 7 = 0 OR contains(coalesce(v.provenance, ''), 'HLS') THEN 'measured' ELSE 'golden' END AS origin, (v.status IS DISTINCT FROM 'adjudicated') AS provisional, e.n_available FROM fx_claims c JOIN fx_interventions i USING (intervention_id) LEFT JOIN fx_newest v ON v.claim_id = c.claim_id LEFT JOIN (SELECT claim_id, count(*) FILTER (WHERE available) AS n_available FROM fx_evidence GROUP BY 1) e ON e.claim_id = c.claim_id"))
def register(spark, d):
    found = newest(spark, d).select("claim_id", "level", "label", "provenance", "status")
    per = a.evidence(spark, d).groupBy("claim_id").agg(F.count(F.when(F.col("available"), 1)).alias("n_available"))
    rows = a.claims(spark, d).join(a.interventions(spark, d).select("intervention_id", "unique_id"), "intervention_id").join(found, "claim_id", "left").join(per, "claim_id", "left")
    return rows.select("claim_id", "unique_id", "level", "label", provenance(F.col("intervention_id") % 7 == 0).alias("origin"), (~F.col("status").eqNullSafe("adjudicated")).alias("provisional"), "n_available")


@query("rm_04", sql(f"SELECT claim_id, CAST(list_position({list(v.DISPLAY_ORDER)!r}, family) AS INT) AS place, family, CASE WHEN NOT available THEN 'unavailable' WHEN agreement >= 0.15 THEN 'agrees' WHEN agreement <= -0.15 THEN 'disagrees' ELSE 'neutral' END AS direction FROM fx_evidence"))
def evidence_tree(spark, d):
    place = F.array_position(F.array(*map(F.lit, v.DISPLAY_ORDER)), F.col("family")).cast("int")
    return a.evidence(spark, d).select("claim_id", place.alias("place"), "family", direction().alias("direction")).orderBy("claim_id", "place")


@query("rm_05", sql("SELECT claim_id, index_name, season, year, value FROM fx_observations WHERE claim_id = 17"))
def temporal_page(spark, d):
    return a.observations(spark, d).where("claim_id = 17").select("claim_id", "index_name", "season", "year", "value").orderBy("index_name", "season", "year")


_FEATURE = """SELECT c.claim_id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || lon || ',' || lat || ']},"properties":{"claim_id":' || c.claim_id || CASE WHEN level IS NULL THEN '' ELSE ',"level":"' || level || '"' END || '}}' AS feature FROM fx_claims c LEFT JOIN fx_newest n USING (claim_id)"""


@query("rm_06", sql(_FEATURE))
def map_page(spark, d):
    """Position and newest level of each claim, as a feature collection's members."""
    rows = a.claims(spark, d).select("claim_id", "lon", "lat").join(newest(spark, d).select("claim_id", "level"), "claim_id", "left")
    return rows.select("claim_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct("claim_id", "level").alias("properties"))).alias("feature"))


@query("rm_07", sql("SELECT claim_id, verdict_id, version, level FROM fx_newest"))
def latest_verdict(spark, d):
    return a.newest(a.verdicts(spark, d)).select("claim_id", "verdict_id", "version", "level")


@query("rm_08", sql("SELECT action, count(*) AS n, count(DISTINCT user_id) AS n_users, max(\"at\") AS latest FROM fx_audit GROUP BY 1"))
def audit_summary(spark, d):
    return a.audit(spark, d).groupBy("action").agg(count().alias("n"), F.count_distinct("user_id").alias("n_users"), F.max("at").alias("latest"))


@query("rm_09", sql("SELECT c.district_lgd, count(*) AS n_claims, count(DISTINCT i.type) AS n_types, min(lon) AS west, max(lat) AS north FROM fx_claims c JOIN fx_interventions i USING (intervention_id) GROUP BY 1"))
def districts(spark, d):
    rows = a.claims(spark, d).join(a.interventions(spark, d), "intervention_id")
    return rows.groupBy("district_lgd").agg(count().alias("n_claims"), F.count_distinct("type").alias("n_types"), F.min("lon").alias("west"), F.max("lat").alias("north"))


@query("rm_11", sql("SELECT v.claim_id, v.level, v.label, v.action, (EXISTS (SELECT 1 FROM fx_adjudications a WHERE a.verdict_id = v.verdict_id)) AS adjudicated, CAST(v.n_available AS INT) AS n_available FROM fx_newest v WHERE v.district_lgd = '5'"))
def evidence_pack(spark, d):
    rows = signed(newest(spark, d).where("district_lgd = '5'"), a.adjudications(spark, d))
    return rows.select("claim_id", "level", "label", "action", "adjudicated", "n_available")


@query("rm_12", sql("SELECT t.type, any_value(ceiling) AS ceiling, any_value(optical) AS optical, any_value(len(rises)) AS n_rises, any_value(len(falls)) AS n_falls, any_value((footprint_min + footprint_max) / 2e0) AS typical, count(intervention_id) AS n_works FROM fx_types t LEFT JOIN fx_interventions i ON i.type = t.type GROUP BY 1"))
def method(spark, d):
    """The declared signatures, and how many works each is applied to."""
    works = a.interventions(spark, d).groupBy("type").agg(count().alias("_n"))
    rows = v.works(spark).join(works, "type", "left")
    return rows.select("type", "ceiling", "optical", F.size("rises").cast("long").alias("n_rises"), F.size("falls").cast("long").alias("n_falls"), ((F.col("footprint_min") + F.col("footprint_max")) / 2.0).alias("typical"), F.coalesce("_n", F.lit(0)).alias("n_works"))


@query("rm_13", sql("SELECT role, count(*) AS n, count(scope_district) AS n_scoped FROM fx_users GROUP BY 1"))
def roles(spark, d):
    return a.users(spark, d).groupBy("role").agg(count().alias("n"), F.count("scope_district").alias("n_scoped"))


@query("rpt_01", sql("SELECT claim_id, concat_ws(',', CASE WHEN NOT detectability_passed THEN 'detectability' END, CASE WHEN n_available < 6 THEN 'coverage' END, CASE WHEN status <> 'adjudicated' THEN 'provisional' END, CASE WHEN (status = 'adjudicated') <> (EXISTS (SELECT 1 FROM fx_adjudications a WHERE a.verdict_id = v.verdict_id)) THEN 'status and ledger disagree' END) AS limits FROM fx_newest v"))
def limitations(spark, d):
    """What limits a verdict, among it that its status and the ledger disagree."""
    rows = signed(newest(spark, d), a.adjudications(spark, d))
    done = F.col("status") == "adjudicated"
    return rows.select("claim_id", F.concat_ws(",", F.when(~F.col("detectability_passed"), "detectability"), F.when(F.col("n_available") < 6, "coverage"), F.when(~done, "provisional"), F.when(done != F.col("adjudicated"), "status and ledger disagree")).alias("limits"))


@query("rpt_02", sql("SELECT district_lgd, CASE WHEN bool_and(contains(coalesce(provenance, ''), 'HLS')) THEN 2 ELSE 4 END AS n_refused FROM fx_newest GROUP BY 1"))
def refused_metrics(spark, d):
    """How many figures a district's page refuses to show: more where some of its verdicts are not measured."""
    lists = F.when(F.bool_and(measured()), F.array(F.lit("causal effect"), F.lit("ranking"))).otherwise(F.array(F.lit("causal effect"), F.lit("ranking"), F.lit("success rate"), F.lit("area treated")))
    return newest(spark, d).groupBy("district_lgd").agg(lists.alias("_l")).select("district_lgd", F.size("_l").alias("n_refused"))


