"""The reconciliation of six evidence families into a verdict, as one projection.

Rows are wide: for each family its agreement, availability and whether it is of cluster scale, beside the gates, the
two quality terms, the number of excluded alternatives and the type of work. No shuffle, no Python: the 18 types are a
broadcast dimension and everything else is column arithmetic. Counts over arrays part the generated code: in one piece it
would be a method of more than 8,000 bytes, which the JVM does not compile.
An unavailable family counts neither for score nor for coverage; it is not a neutral one.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v

Config = v.Config
DEFAULT = v.Config()


def _agreement(f: str) -> Column:
    return F.col(f"{f}_agreement")


def _available(f: str) -> Column:
    return F.col(f"{f}_available")


def _count(conditions) -> Column:
    return reduce(add, [F.when(c, 1).otherwise(0) for c in conditions])


def aggregate(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """support, weight_total, score, coverage, quality, confidence; the number of families that are available."""
    support = reduce(add, [F.when(_available(f) & (F.abs(_agreement(f)) >= config.epsilon), F.lit(config.weight[f]) * _agreement(f)).otherwise(0.0) for f in v.FAMILIES])
    total = reduce(add, [F.when(_available(f), F.lit(config.weight[f])).otherwise(0.0) for f in v.FAMILIES])
    available = F.size(F.filter(F.array(*map(_available, v.FAMILIES)), lambda x: x))
    df = df.withColumns({"support": support, "weight_total": total, "n_available": available})
    df = df.withColumns({"score": F.col("support") / F.greatest("weight_total", F.lit(1e-9)), "coverage": F.col("weight_total") / F.lit(config.weight_sum), "quality": F.col("metadata_integrity") * F.col("data_sufficiency")})
    return df.withColumn("confidence", F.abs("score") * F.col("coverage") * F.col("quality"))


def tally(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Counts of families that agree, disagree; the first to agree; cluster evidence."""
    agrees = {f: _available(f) & (_agreement(f) >= config.agreeing) for f in v.FAMILIES}
    differs = {f: _available(f) & (_agreement(f) <= config.disagreeing) for f in v.FAMILIES}
    cluster = {f: _available(f) & F.col(f"{f}_cluster") for f in v.FAMILIES}
    listed = lambda which: F.array_join(F.array_compact(F.array(*(F.when(which[f], f) for f in v.FAMILIES))), ",")
    return df.withColumns(
        {
            "n_agreeing": _count(agrees.values()),
            "n_disagreeing": _count(differs.values()),
            "n_independent_agreeing": _count(agrees[f] for f in v.INDEPENDENT),
            "n_independent_disagreeing": _count(differs[f] for f in v.INDEPENDENT),
            "n_cluster": _count(cluster.values()),
            "cluster_agrees": F.exists(F.array(*(cluster[f] & agrees[f] for f in v.FAMILIES)), lambda x: x),
            "agreeing": listed(agrees),
            "disagreeing": listed(differs),
        }
    )


def satellite_block(config: Config = DEFAULT) -> Column:
    """Why absence in the imagery does not contradict the claim; null if it does."""
    return (
        F.when(~F.col("detectability_passed"), "gate_failed")
        .when(~F.col("optical"), "type_not_optically_assessable")
        .when(F.col("data_sufficiency") < config.min_sufficiency, "insufficient_data")
        .when(F.col("n_independent_disagreeing") < config.n3_disagreeing, "too_few_independent_disagreeing")
        .when(F.col("n_excluded") == 0, "no_alternative_excluded")
    )


def terrain_block(config: Config = DEFAULT) -> Column:
    """Why the terrain does not contradict the claim; null if it does. Asked only where the gate failed."""
    return (
        F.when(F.col("detectability_passed"), "gate_passed_use_satellite_path")
        .when(~F.col("terrain_available"), "no_terrain_evidence")
        .when(F.col("terrain_agreement") > config.categorical, "terrain_not_categorically_implausible")
        .when(~F.col("escalated"), "not_escalated_to_cluster")
        .when(F.col("n_cluster") == 0, "no_cluster_scale_evidence")
        .when(F.col("cluster_agrees"), "cluster_evidence_corroborates")
        .when(F.col("n_excluded") == 0, "no_alternative_excluded")
    )


def label_for(level: Column, score: Column, config: Config = DEFAULT) -> Column:
    return (
        F.when(level == "N3_contradicted", "CONTRADICTED")
        .when(level == "N2_unsupported", "UNSUPPORTED")
        .when(level.isin("N1_inconclusive", "L0_recorded"), "INCONCLUSIVE")
        .when(score >= config.corroborated, "CORROBORATED")
        .when(score >= config.partial, "PARTIAL")
        .when(level.isNotNull(), "INCONCLUSIVE")
    )


def levels(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Branch of the cascade, level after ceiling and terrain cap, and the rules that led there."""
    df = df.withColumns({"sat_block": satellite_block(config), "ter_block": terrain_block(config)})
    control = F.col("control_available") & (F.col("control_agreement") >= config.agreeing)
    three = (F.col("n_agreeing") >= config.l3_families) & F.col("temporal_available")
    low = F.col("data_sufficiency") < config.min_sufficiency
    branch = (
        F.when(F.col("sat_block").isNull(), "n3_satellite")
        .when(F.col("ter_block").isNull(), "n3_terrain")
        .when((F.col("score") <= config.n2_score) & low, "n1_unsupported_unseen")
        .when(F.col("score") <= config.n2_score, "n2")
        .when(F.col("n_available") == 0, "l0")
        .when((F.col("score") < config.partial) & (F.col("n_disagreeing") > 0) & (F.col("n_agreeing") > 0), "n1_conflict")
        .when(F.col("score") < config.partial, "n1_floor")
        .when(low, "n1_unseen")
        .when(three & control & (F.col("coverage") >= config.l4_coverage), "l4")
        .when(three, "l3")
        .when((F.col("n_agreeing") >= config.l2_families) & (F.col("n_independent_agreeing") >= 1), "l2")
        .when(F.col("n_agreeing") == 1, "l1")
        .otherwise("n1_default")
    )
    df = df.withColumn("branch", branch)
    reached = F.array_position(F.array(*map(F.lit, ("l1", "l2", "l3", "l4"))), F.col("branch")).cast("int")  # 0: another branch
    df = df.withColumn("_reached", reached)
    df = df.withColumn("_clamped", F.when(F.col("_reached") > 0, F.least("_reached", "ceiling")))
    capped = (F.col("_reached") >= 3) & (F.col("_clamped") > 2) & F.col("terrain_available") & (F.col("terrain_agreement") <= config.categorical)
    df = df.withColumn("_capped", F.coalesce(capped, F.lit(False)))
    df = df.withColumn("_final", F.when(F.col("_capped"), 2).otherwise(F.col("_clamped")))
    names = F.array(*map(F.lit, v.POSITIVE))
    level = (
        F.when(F.col("_final").isNotNull(), F.get(names, F.col("_final")))
        .when(F.col("branch") == "l0", "L0_recorded")
        .when(F.col("branch").startswith("n3"), "N3_contradicted")
        .when(F.col("branch") == "n2", "N2_unsupported")
        .otherwise("N1_inconclusive")
    )
    df = df.withColumn("level", level)
    is_ = lambda *names: F.col("branch").isin(*names)
    blocked = [F.when(is_("n1_unsupported_unseen", "n2"), F.concat(F.lit("n3_satellite_blocked_by="), "sat_block")), F.when(is_("n1_unsupported_unseen", "n2"), F.concat(F.lit("n3_terrain_blocked_by="), "ter_block"))]
    path = F.array_compact(
        F.array(
            F.when(is_("n3_satellite"), "N3_SATELLITE_PATH").when(is_("n3_terrain"), "N3_TERRAIN_PATH").when(is_("n2"), "N2_UNSUPPORTED").when(is_("l0"), "L0_RECORDED").when(is_("l4"), "L4_CONTROL_DIFFERENCED").when(is_("l3"), "L3_MULTI_INDICATOR").when(is_("l2"), "L2_CORROBORATED").when(is_("l1"), "L1_OBSERVED").otherwise("N1_DEFAULT"),
            F.when(is_("n3_satellite"), F.concat(F.lit("independent_disagreeing="), "n_independent_disagreeing")).when(is_("n3_terrain"), F.concat(F.lit("cluster_families="), "n_cluster")),
            F.when(is_("n1_unsupported_unseen", "n1_unseen"), "reason=data_sufficiency_below_threshold").when(is_("l0"), "reason=no_family_available").when(is_("n1_conflict"), "reason=conflicting_families").when(is_("n1_floor"), "reason=net_support_below_floor"),
            *blocked,
            F.when(is_("n1_conflict"), F.concat(F.lit("agreeing="), "agreeing")).when(is_("l1"), F.concat(F.lit("single_family="), "agreeing")).when(is_("l4", "l3", "l2", "n1_default"), F.concat(F.lit("agreeing="), "n_agreeing")),
            F.when(is_("n1_conflict"), F.concat(F.lit("disagreeing="), "disagreeing")),
            F.when(is_("n1_conflict", "n1_floor", "n1_default"), F.format_string("score=%.4f", "score")).when(is_("n1_unseen"), F.format_string("data_sufficiency=%.4f", "data_sufficiency")).when(is_("l4"), F.format_string("coverage=%.4f", "coverage")),
            F.when(F.col("_clamped") < F.col("_reached"), F.concat(F.lit("CEILING_CLAMP["), "type", F.lit("->"), F.get(names, F.col("_clamped")), F.lit("]"))),
            F.when(F.col("_capped"), F.concat(F.lit("TERRAIN_CONTRADICTION_CAP["), F.get(names, F.col("_clamped")), F.lit("->L2_corroborated]"))),
            F.when(F.col("_capped"), F.concat(F.lit("n3_terrain_blocked_by="), "ter_block")),
        )
    )
    df = df.withColumns({"rule_path": path, "label": label_for(F.col("level"), F.col("score"), config), "clamped": F.coalesce(F.col("_clamped") < F.col("_reached"), F.lit(False)), "capped": F.col("_capped")})
    return df.drop("_reached", "_clamped", "_capped", "_final")


def recommend(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    level = F.col("level")
    waiting = level.isin("N1_inconclusive", "L0_recorded")
    broken, unseen = F.col("metadata_integrity") < 0.5, F.col("data_sufficiency") < config.min_sufficiency
    driven = F.col("terrain_available") & (F.col("terrain_agreement") <= config.disagreeing)
    action = (
        F.when(level.isin("N3_contradicted", "N2_unsupported"), "physical_verification")
        .when(waiting & broken, "recapture_geotag")
        .when(waiting & ~F.col("optical"), "no_action")
        .when(waiting & unseen, "confirm_next_cycle")
        .when(waiting & (F.col("n_available") == 0), "data_quality_fix")
        .when(waiting, "confirm_next_cycle")
        .when(level.isin("L3_multi_indicator", "L4_control_differenced") | ~F.col("optical"), "no_action")
        .otherwise("confirm_next_cycle")
    )
    priority = (
        F.when((level == "N3_contradicted") & driven, 1)
        .when(level == "N3_contradicted", 2)
        .when(level == "N2_unsupported", 3)
        .when(F.col("action").isin("recapture_geotag", "data_quality_fix"), 4)
    )
    return df.withColumn("action", action).withColumn("priority", priority)


def dissent(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """What speaks against the verdict or limits it, one entry a finding; never empty."""
    positive = F.col("level").isin("L1_observed", "L2_corroborated", "L3_multi_indicator", "L4_control_differenced")
    contrary = [F.when(_available(f) & F.when(positive, _agreement(f) <= config.disagreeing).otherwise(_agreement(f) >= config.agreeing), F.format_string(f"{f} points the other way (%+.2f)", _agreement(f))) for f in v.FAMILIES]
    failed, n3 = ~F.col("detectability_passed"), F.col("level") == "N3_contradicted"
    entries = [
        *contrary,
        F.when(n3 & failed, "below the detection limit: absence in imagery alone would be INCONCLUSIVE; the verdict rests on terrain"),
        F.when(failed & ~n3, F.when(F.col("escalated"), "below the detection limit: assessed as a cluster").otherwise("below the detection limit: no cluster to assess")),
        F.when(F.col("n_cluster") > 0, "some evidence describes the neighbourhood, not this work"),
        F.when(F.col("scene_scale").isin("close_up", "unknown") & F.col("photo_available"), "the photograph cannot be set against a pixel"),
        F.when(~F.col("optical"), "this type has no optical signature: existence only"),
        F.when(F.col("optical") & F.col("noted"), "this type is limited in what can be observed"),
        F.when(F.col("n_available") < len(v.FAMILIES), F.format_string("families unavailable: coverage is %.2f", "coverage")),
        F.when(F.col("metadata_integrity") < 0.9, "metadata integrity lowers the confidence"),
        F.when(F.col("data_sufficiency") < 0.9, "data sufficiency is below ideal"),
        F.when(positive, "this is not a causal claim"),
    ]
    repeated = lambda text, n: F.array_repeat(F.lit(text), n.cast("int"))
    return df.withColumn("dissent", F.concat(F.array_compact(F.array(*entries)), repeated("an alternative explanation was weighed", F.col("n_alternatives")), repeated("a producer reports a data limitation", F.col("n_limitations"))))


def reconcile(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Verdicts beside their inputs, under the thresholds of ``config``. A type outside the vocabulary is an error, not a dropped row."""
    kinds = v.works(df.sparkSession).select(F.col("type").alias("_type"), "ceiling", "optical", "noted", "footprint_min", "footprint_max")
    df = df.join(F.broadcast(kinds), F.col("type") == F.col("_type"), "left").drop("_type")  # 18 rows
    df = df.withColumn("ceiling", F.when(F.col("ceiling").isNull(), F.raise_error(F.concat(F.lit("no expectations for type "), F.coalesce("type", F.lit("null")))).cast("int")).otherwise(F.col("ceiling")))
    for step in (aggregate, tally, levels, recommend, dissent):
        df = step(df, config)
    return df


def invariants(df: DataFrame) -> DataFrame:
    """Names of the invariants that a verdict breaks; an empty array for a sound one."""
    inside = reduce(and_, [_agreement(f).between(-1, 1) for f in v.FAMILIES])
    checks = {"agreement_range": inside, "quality_range": F.col("metadata_integrity").between(0, 1) & F.col("data_sufficiency").between(0, 1), "confidence_bound": F.col("confidence") <= F.abs("score") + 5e-4, "dissent_present": F.size("dissent") > 0, "terrain_disclosure": ~((F.col("branch") == "n3_terrain") & ~F.exists("dissent", lambda x: x.contains("INCONCLUSIVE")))}
    return df.withColumn("broken", F.array_compact(F.array(*(F.when(~ok, name) for name, ok in checks.items()))))
