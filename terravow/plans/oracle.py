"""The comparing SQL: evidence relations as common table expressions, and a helper that adds those a statement names.

Written for another engine and apart from the DataFrames: it shares the scalar fixture rules, not the operators.
"""

from __future__ import annotations

import re

from ..functions import vocabulary as v
from ..sources import adapter as a


def _rules(rule: dict[str, str]) -> str:
    return ", ".join(a.rules(rule, "VARCHAR"))


def _sum(parts) -> str:
    return "(" + " + ".join(parts) + ")"


def _n(conditions) -> str:
    return _sum(f"(CASE WHEN {c} THEN 1 ELSE 0 END)" for c in conditions)


_agree = {f: f"({f}_available AND {f}_agreement >= 0.35e0)" for f in v.FAMILIES}
_differ = {f: f"({f}_available AND {f}_agreement <= -0.35e0)" for f in v.FAMILIES}
_cluster = {f: f"({f}_available AND {f}_cluster)" for f in v.FAMILIES}
_listed = lambda which: "array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN {which[f]} THEN '{f}' END" for f in v.FAMILIES) + "] IF x IS NOT NULL], ',')"
_positive = "level IN ('L1_observed', 'L2_corroborated', 'L3_multi_indicator', 'L4_control_differenced')"
_waiting = "level IN ('N1_inconclusive', 'L0_recorded')"
_VALUES = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool) else repr(list(x)) if isinstance(x, tuple) and x else "CAST([] AS VARCHAR[])" if isinstance(x, tuple) else repr(x) if isinstance(x, str) else f"{x!r}e0" if isinstance(x, float) else str(x) for x in row) + ")" for row in rows)

CTE = {
    "fx_types": "SELECT * FROM (VALUES " + _VALUES([(i, w.name, w.rises, w.falls, *w.footprint, w.ceiling, w.optical, w.noted) for i, w in enumerate(v.WORKS)]) + ") AS t(type_index, type, rises, falls, footprint_min, footprint_max, ceiling, optical, noted)",
    "fx_levels": "SELECT * FROM (VALUES " + _VALUES([(n, i, v.SEVERITY.get(n), v.BANDS[n]) for i, n in enumerate(v.LEVELS)]) + ") AS t(level, ladder, severity, band)",
    "fx_interventions": f"SELECT p.*, t.type FROM (SELECT {_rules(a.WORK)} FROM part) p JOIN fx_types t USING (type_index)",
    "fx_claims": f"SELECT {_rules(a.CLAIM)}, o_orderkey % (SELECT count(*) FROM part) AS intervention_id FROM orders JOIN customer ON o_custkey = c_custkey",
    "fx_lines": f"SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(a.VERSION_ORDER)}) AS version FROM lineitem",
    "fx_inputs": f"SELECT l.*, c.intervention_id, c.district_lgd, c.detectability, i.type, i.unique_id, i.expected_footprint_m2, coalesce(c.detectability, 'failed') = 'passed' AS detectability_passed FROM (SELECT l_orderkey AS claim_id, version, {_rules(a.INPUT)} FROM fx_lines) l JOIN fx_claims c USING (claim_id) JOIN fx_interventions i USING (intervention_id)",
    "fx_sums": "SELECT x.*, t.ceiling, t.optical, t.noted, t.footprint_min, t.footprint_max, "
    + _sum(f"(CASE WHEN {f}_available AND abs({f}_agreement) >= 0.05e0 THEN {v.WEIGHTS[f]}e0 * {f}_agreement ELSE 0e0 END)" for f in v.FAMILIES) + " AS support, "
    + _sum(f"(CASE WHEN {f}_available THEN {v.WEIGHTS[f]}e0 ELSE 0e0 END)" for f in v.FAMILIES) + " AS weight_total FROM fx_inputs x JOIN fx_types t USING (type)",
    "fx_scores": f"SELECT *, support / greatest(weight_total, 1e-9) AS score, weight_total / CAST('{v.WEIGHT_SUM!r}' AS DOUBLE) AS coverage, metadata_integrity * data_sufficiency AS quality, abs(support / greatest(weight_total, 1e-9)) * (weight_total / CAST('{v.WEIGHT_SUM!r}' AS DOUBLE)) * (metadata_integrity * data_sufficiency) AS confidence FROM fx_sums",
    "fx_tallies": f"SELECT *, {_n(f'{f}_available' for f in v.FAMILIES)} AS n_available, {_n(_agree.values())} AS n_agreeing, {_n(_differ.values())} AS n_disagreeing, {_n(_agree[f] for f in v.INDEPENDENT)} AS n_independent_agreeing, {_n(_differ[f] for f in v.INDEPENDENT)} AS n_independent_disagreeing, {_n(_cluster.values())} AS n_cluster, ({' OR '.join(f'({_cluster[f]} AND {_agree[f]})' for f in v.FAMILIES)}) AS cluster_agrees, {_listed(_agree)} AS agreeing, {_listed(_differ)} AS disagreeing FROM fx_scores",
    "fx_blocks": "SELECT *, CASE WHEN NOT detectability_passed THEN 'gate_failed' WHEN NOT optical THEN 'type_not_optically_assessable' WHEN data_sufficiency < 0.35e0 THEN 'insufficient_data' WHEN n_independent_disagreeing < 2 THEN 'too_few_independent_disagreeing' WHEN n_excluded = 0 THEN 'no_alternative_excluded' END AS sat_block, CASE WHEN detectability_passed THEN 'gate_passed_use_satellite_path' WHEN NOT terrain_available THEN 'no_terrain_evidence' WHEN terrain_agreement > -1e0 THEN 'terrain_not_categorically_implausible' WHEN NOT escalated THEN 'not_escalated_to_cluster' WHEN n_cluster = 0 THEN 'no_cluster_scale_evidence' WHEN cluster_agrees THEN 'cluster_evidence_corroborates' WHEN n_excluded = 0 THEN 'no_alternative_excluded' END AS ter_block FROM fx_tallies",
    "fx_branches": "SELECT *, CASE WHEN sat_block IS NULL THEN 'n3_satellite' WHEN ter_block IS NULL THEN 'n3_terrain' WHEN score <= -0.15e0 AND data_sufficiency < 0.35e0 THEN 'n1_unsupported_unseen' WHEN score <= -0.15e0 THEN 'n2' WHEN n_available = 0 THEN 'l0' WHEN score < 0.15e0 AND n_disagreeing > 0 AND n_agreeing > 0 THEN 'n1_conflict' WHEN score < 0.15e0 THEN 'n1_floor' WHEN data_sufficiency < 0.35e0 THEN 'n1_unseen' WHEN n_agreeing >= 3 AND temporal_available AND control_available AND control_agreement >= 0.35e0 AND coverage >= 0.7e0 THEN 'l4' WHEN n_agreeing >= 3 AND temporal_available THEN 'l3' WHEN n_agreeing >= 2 AND n_independent_agreeing >= 1 THEN 'l2' WHEN n_agreeing = 1 THEN 'l1' ELSE 'n1_default' END AS branch FROM fx_blocks",
    "fx_ranks": "SELECT *, CASE branch WHEN 'l4' THEN 4 WHEN 'l3' THEN 3 WHEN 'l2' THEN 2 WHEN 'l1' THEN 1 END AS reached, least(CASE branch WHEN 'l4' THEN 4 WHEN 'l3' THEN 3 WHEN 'l2' THEN 2 WHEN 'l1' THEN 1 END, CASE WHEN branch IN ('l4', 'l3', 'l2', 'l1') THEN ceiling END) AS clamped FROM fx_branches",
    "fx_levelled": "SELECT *, coalesce(reached >= 3 AND clamped > 2 AND terrain_available AND terrain_agreement <= -1e0, false) AS capped, CASE WHEN reached >= 3 AND clamped > 2 AND terrain_available AND terrain_agreement <= -1e0 THEN 'L2_corroborated' WHEN reached IS NOT NULL THEN ['L0_recorded', 'L1_observed', 'L2_corroborated', 'L3_multi_indicator', 'L4_control_differenced'][clamped + 1] WHEN branch = 'l0' THEN 'L0_recorded' WHEN branch IN ('n3_satellite', 'n3_terrain') THEN 'N3_contradicted' WHEN branch = 'n2' THEN 'N2_unsupported' ELSE 'N1_inconclusive' END AS level FROM fx_ranks",
    "fx_labelled": "SELECT *, CASE WHEN level = 'N3_contradicted' THEN 'CONTRADICTED' WHEN level = 'N2_unsupported' THEN 'UNSUPPORTED' WHEN level IN ('N1_inconclusive', 'L0_recorded') THEN 'INCONCLUSIVE' WHEN score >= 0.35e0 THEN 'CORROBORATED' WHEN score >= 0.15e0 THEN 'PARTIAL' ELSE 'INCONCLUSIVE' END AS label, "
    f"CASE WHEN level IN ('N3_contradicted', 'N2_unsupported') THEN 'physical_verification' WHEN {_waiting} AND metadata_integrity < 0.5e0 THEN 'recapture_geotag' WHEN {_waiting} AND NOT optical THEN 'no_action' WHEN {_waiting} AND data_sufficiency < 0.35e0 THEN 'confirm_next_cycle' WHEN {_waiting} AND n_available = 0 THEN 'data_quality_fix' WHEN {_waiting} THEN 'confirm_next_cycle' WHEN level IN ('L3_multi_indicator', 'L4_control_differenced') OR NOT optical THEN 'no_action' ELSE 'confirm_next_cycle' END AS action FROM fx_levelled",
    "fx_verdicts": "SELECT *, claim_id * 100 + version AS verdict_id, CASE WHEN level = 'N3_contradicted' AND terrain_available AND terrain_agreement <= -0.35e0 THEN 1 WHEN level = 'N3_contradicted' THEN 2 WHEN level = 'N2_unsupported' THEN 3 WHEN action IN ('recapture_geotag', 'data_quality_fix') THEN 4 END AS priority, "
    "CASE WHEN version = max(version) OVER (PARTITION BY claim_id) THEN CASE WHEN claim_id % 4 = 0 THEN 'adjudicated' ELSE 'pending' END WHEN claim_id % 4 = 0 AND version = 1 THEN 'adjudicated' ELSE 'superseded' END AS status FROM fx_labelled",
    "fx_newest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY version DESC) AS nth FROM fx_verdicts) WHERE nth = 1",
    "fx_newest_inputs": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY version DESC) AS nth FROM fx_inputs) WHERE nth = 1",
    "fx_evidence": " UNION ALL ".join(f"SELECT claim_id, district_lgd, '{f}' AS family, CAST({f}_agreement AS DECIMAL(4,3)) AS agreement, {f}_available AS available, {f}_cluster AS cluster_scale FROM fx_newest_inputs" for f in v.FAMILIES),
    "fx_adjudications": f"SELECT {_rules(a.SIGNED)}, o_orderkey * 100 + 1 AS verdict_id FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 50 = 1",
    "fx_audit": f"SELECT {_rules(a.AUDIT)} FROM events",
    "fx_users": "SELECT c_custkey AS user_id, concat('user', CAST(c_custkey AS VARCHAR)) AS username, CASE c_custkey % 6 WHEN 0 THEN 'WDT' WHEN 1 THEN 'PIA' WHEN 2 THEN 'WCDC' WHEN 3 THEN 'SLNA' WHEN 4 THEN 'DOLR_ADMIN' ELSE 'READONLY' END AS role, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS scope_district, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'state' END AS scope_state FROM customer",
    "fx_observed": "SELECT l_partkey AS claim_id, CASE WHEN l_suppkey % 2 = 0 THEN 'NDVI' ELSE 'MNDWI' END AS index_name, CASE WHEN month(l_shipdate) BETWEEN 6 AND 10 THEN 'kharif' WHEN month(l_shipdate) BETWEEN 3 AND 5 THEN 'summer' ELSE 'rabi' END AS season, CAST(year(l_shipdate) + CASE WHEN month(l_shipdate) >= 11 THEN 1 ELSE 0 END AS INT) AS year, l_discount, l_tax FROM lineitem",
    "fx_observations": "SELECT claim_id, index_name, season, year, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / 1e2 / count(*) * 4e0 - 0.2e0 AS value, max(CAST(round(l_tax * 100) AS BIGINT)) / 1e1 AS data_sufficiency, count(*) AS n_scenes FROM fx_observed GROUP BY ALL",
    "fx_candidates": f"SELECT {_rules(a.CANDIDATE)} FROM supplier",
    "fx_pixels": f"SELECT scene_id, row, col, min(red) AS red, min(nir) AS nir, min(green) AS green, min(blue) AS blue, min(swir1) AS swir1, min(fmask) AS fmask FROM (SELECT {_rules(a.PIXEL)} FROM lineitem) GROUP BY ALL",
    "fx_phash": "SELECT vec_id AS image_id, CAST(vec_id % 5 AS VARCHAR) AS district_lgd, CAST(list_sum([CASE WHEN CAST(embedding[i] AS DOUBLE) > (CAST(list_sort(embedding)[32] AS DOUBLE) + CAST(list_sort(embedding)[33] AS DOUBLE)) / 2 THEN CASE WHEN i = 64 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE CAST(1 AS HUGEINT) << CAST(i - 1 AS INT) END ELSE CAST(0 AS HUGEINT) END FOR i IN generate_series(1, 64)]) AS BIGINT) AS phash FROM embeddings",
}


def sql(body: str, **local: str) -> str:
    """``body`` below the relations that it and ``local`` name; ``local`` adds relations of its own."""
    known, order, seen = CTE | local, [], set()

    def need(text: str) -> None:
        for name in re.findall(r"\b\w+\b", text):
            if name in known and name not in seen:
                seen.add(name)
                need(known[name])
                order.append(name)

    need(body)
    return ("WITH " + ", ".join(f"{n} AS ({known[n]})" for n in order) + " " if order else "") + body
