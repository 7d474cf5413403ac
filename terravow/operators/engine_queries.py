"""The engine's steps as queries over every verdict version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stored
from ..plans.oracle import sql
from ..plans.registry import query
from ..sources import adapter as a
from . import engine

_STORED = "floor({0} * 1e4 + 0.5e0) / 1e4 AS {0}"


@query("eng_01", sql(f"SELECT claim_id, version, level, label, action, priority, {', '.join(_STORED.format(c) for c in ('score', 'confidence', 'coverage', 'quality'))} FROM fx_verdicts"))
def reconcile_all(spark, d) -> DataFrame:
    """Every bundle's verdict."""
    return a.verdicts(spark, d).select("claim_id", "version", "level", "label", "action", F.col("priority").cast("int"), *(stored(F.col(c)).alias(c) for c in ("score", "confidence", "coverage", "quality")))


@query("eng_02", sql("SELECT claim_id, version, support, weight_total, score, coverage, quality, confidence FROM fx_scores"))
def aggregates(spark, d) -> DataFrame:
    return engine.aggregate(a.verdict_inputs(spark, d)).select("claim_id", "version", "support", "weight_total", "score", "coverage", "quality", "confidence")


@query("eng_03", sql("SELECT claim_id, version, CAST(n_agreeing AS INT) AS n_agreeing, CAST(n_disagreeing AS INT) AS n_disagreeing, agreeing, disagreeing FROM fx_tallies"))
def tallies(spark, d) -> DataFrame:
    return engine.tally(a.verdict_inputs(spark, d)).select("claim_id", "version", "n_agreeing", "n_disagreeing", "agreeing", "disagreeing")


@query("eng_04", sql("SELECT coalesce(sat_block, 'contradicts') AS block, count(*) AS n FROM fx_blocks GROUP BY 1"))
def satellite_blocks(spark, d) -> DataFrame:
    return a.verdicts(spark, d).groupBy(F.coalesce("sat_block", F.lit("contradicts")).alias("block")).agg(F.count(F.lit(1)).alias("n"))


@query("eng_05", sql("SELECT coalesce(ter_block, 'contradicts') AS block, count(*) AS n FROM fx_blocks GROUP BY 1"))
def terrain_blocks(spark, d) -> DataFrame:
    return a.verdicts(spark, d).groupBy(F.coalesce("ter_block", F.lit("contradicts")).alias("block")).agg(F.count(F.lit(1)).alias("n"))


@query("eng_06", sql("SELECT branch, level, count(*) AS n FROM fx_levelled GROUP BY ALL"))
def cascade(spark, d) -> DataFrame:
    return a.verdicts(spark, d).groupBy("branch", "level").agg(F.count(F.lit(1)).alias("n"))


@query("eng_07", sql("SELECT claim_id, version, branch FROM fx_branches WHERE branch IN ('l4', 'l3', 'l2', 'l1')"))
def positive_ladder(spark, d) -> DataFrame:
    return a.verdicts(spark, d).where(F.col("branch").isin("l4", "l3", "l2", "l1")).select("claim_id", "version", "branch")


@query("eng_08", sql("SELECT type, branch, level, count(*) AS n FROM fx_levelled WHERE clamped < reached GROUP BY ALL"))
def ceiling_clamps(spark, d) -> DataFrame:
    # counted before it is filtered: a filter on a derived column would be pushed through, and copy, the whole cascade
    return a.verdicts(spark, d).groupBy("type", "branch", "level").agg(F.count(F.when(F.col("clamped"), 1)).alias("n")).where("n > 0")


@query("eng_09", sql("SELECT claim_id, version, level, ter_block FROM fx_levelled WHERE capped"))
def terrain_caps(spark, d) -> DataFrame:
    # an empty array explodes to no row: a filter that the optimizer does not push into the cascade
    kept = F.explode(F.array_compact(F.array(F.when(F.col("capped"), F.col("ter_block")))))
    return a.verdicts(spark, d).select("claim_id", "version", "level", kept.alias("ter_block"))


@query(
    "eng_10",
    sql(
        "SELECT claim_id, version, array_to_string([x FOR x IN [CASE branch WHEN 'n3_satellite' THEN 'N3_SATELLITE_PATH' WHEN 'n3_terrain' THEN 'N3_TERRAIN_PATH' WHEN 'n2' THEN 'N2_UNSUPPORTED' WHEN 'l0' THEN 'L0_RECORDED' WHEN 'l4' THEN 'L4_CONTROL_DIFFERENCED' WHEN 'l3' THEN 'L3_MULTI_INDICATOR' WHEN 'l2' THEN 'L2_CORROBORATED' WHEN 'l1' THEN 'L1_OBSERVED' ELSE 'N1_DEFAULT' END, "
        "CASE branch WHEN 'n3_satellite' THEN 'independent_disagreeing=' || n_independent_disagreeing WHEN 'n3_terrain' THEN 'cluster_families=' || n_cluster END, "
        "CASE WHEN branch IN ('n1_unsupported_unseen', 'n1_unseen') THEN 'reason=data_sufficiency_below_threshold' WHEN branch = 'l0' THEN 'reason=no_family_available' WHEN branch = 'n1_conflict' THEN 'reason=conflicting_families' WHEN branch = 'n1_floor' THEN 'reason=net_support_below_floor' END, "
        "CASE WHEN branch IN ('n1_unsupported_unseen', 'n2') THEN 'n3_satellite_blocked_by=' || sat_block END, CASE WHEN branch IN ('n1_unsupported_unseen', 'n2') THEN 'n3_terrain_blocked_by=' || ter_block END, "
        "CASE WHEN branch = 'n1_conflict' THEN 'agreeing=' || agreeing WHEN branch = 'l1' THEN 'single_family=' || agreeing WHEN branch IN ('l4', 'l3', 'l2', 'n1_default') THEN 'agreeing=' || n_agreeing END, CASE WHEN branch = 'n1_conflict' THEN 'disagreeing=' || disagreeing END, "
        "CASE WHEN clamped < reached THEN 'CEILING_CLAMP[' || type || '->' || ['L0_recorded', 'L1_observed', 'L2_corroborated', 'L3_multi_indicator', 'L4_control_differenced'][clamped + 1] || ']' END, "
        "CASE WHEN capped THEN 'TERRAIN_CONTRADICTION_CAP[' || ['L0_recorded', 'L1_observed', 'L2_corroborated', 'L3_multi_indicator', 'L4_control_differenced'][clamped + 1] || '->L2_corroborated]' END, CASE WHEN capped THEN 'n3_terrain_blocked_by=' || ter_block END] IF x IS NOT NULL], ';') AS rules FROM fx_levelled"
    ),
)
def rule_paths(spark, d) -> DataFrame:
    """The rules that led to each verdict; formatted numbers are left out of the comparison."""
    plain = F.filter("rule_path", lambda x: ~x.rlike("^(score|coverage|data_sufficiency)="))
    return a.verdicts(spark, d).select("claim_id", "version", F.array_join(plain, ";").alias("rules"))


@query("eng_11", sql("SELECT level, label, count(*) AS n FROM fx_labelled GROUP BY ALL"))
def labels(spark, d) -> DataFrame:
    return a.verdicts(spark, d).groupBy("level", "label").agg(F.count(F.lit(1)).alias("n"))


@query("eng_12", sql("SELECT action, CAST(priority AS INT) AS priority, count(*) AS n FROM fx_verdicts GROUP BY ALL"))
def actions(spark, d) -> DataFrame:
    return a.verdicts(spark, d).groupBy("action", F.col("priority").cast("int").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


_pos = "level IN ('L1_observed', 'L2_corroborated', 'L3_multi_indicator', 'L4_control_differenced')"
_one = lambda c: f"(CASE WHEN {c} THEN 1 ELSE 0 END)"


@query(
    "eng_13",
    sql(
        "SELECT claim_id, version, CAST("
        + " + ".join(_one(f"{f}_available AND CASE WHEN {_pos} THEN {f}_agreement <= -0.35e0 ELSE {f}_agreement >= 0.35e0 END") for f in engine.v.FAMILIES)
        + " + " + _one("NOT detectability_passed") + " + " + _one("n_cluster > 0") + " + " + _one("scene_scale IN ('close_up', 'unknown') AND photo_available") + " + " + _one("NOT optical OR noted")
        + " + " + _one("n_available < 6") + " + " + _one("metadata_integrity < 0.9e0") + " + " + _one("data_sufficiency < 0.9e0") + " + " + _one(_pos)
        + " + n_alternatives + n_limitations AS INT) AS n_dissent FROM fx_verdicts"
    ),
)
def dissent_counts(spark, d) -> DataFrame:
    return a.verdicts(spark, d).select("claim_id", "version", F.size("dissent").alias("n_dissent"))


@query("eng_14", sql("SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_broken FROM fx_verdicts"))
def shippable(spark, d) -> DataFrame:
    """No verdict breaks an invariant."""
    found = engine.invariants(a.verdicts(spark, d))
    return found.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size("broken") > 0, 1)).alias("n_broken"))


@query("eng_15")
def lineage(spark, d) -> DataFrame:
    """What a verdict was made from, as JSON; enough to make it again, and nothing that changes with time."""
    return a.verdicts(spark, d).select("claim_id", "version", F.to_json(F.struct("type", "detectability_passed", "escalated", "scene_scale", "metadata_integrity", "data_sufficiency", F.struct("support", "weight_total", "score", "coverage", "quality", "confidence").alias("aggregate"), F.struct(*(F.struct(F.col(f"{f}_agreement").alias("agreement"), F.col(f"{f}_available").alias("available"), F.col(f"{f}_cluster").alias("cluster_scale")).alias(f) for f in engine.v.FAMILIES)).alias("families"))).alias("lineage"))


STRICTER = engine.Config(epsilon=0.2, l4_coverage=0.5, n2_score=-0.25)
_stricter = lambda text: text.replace(">= 0.05e0", ">= 0.2e0").replace("coverage >= 0.7e0", "coverage >= 0.5e0").replace("score <= -0.15e0", "score <= -0.25e0")


@query("eng_16", _stricter(sql("SELECT level, action, count(*) AS n FROM fx_verdicts GROUP BY ALL")))
def other_thresholds(spark, d) -> DataFrame:
    """Verdicts under another configuration: what the engine uses is a parameter."""
    return engine.reconcile(a.verdict_inputs(spark, d), STRICTER).groupBy("level", "action").agg(F.count(F.lit(1)).alias("n"))
