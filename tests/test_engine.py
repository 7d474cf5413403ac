"""Verdicts of declared bundles, and properties of random ones."""

import random

import pytest

from terravow.functions import vocabulary as v
from terravow.operators.engine import invariants, reconcile

BASE = {"type": "check_dam", "detectability_passed": True, "escalated": False, "scene_scale": "site", "metadata_integrity": 0.95, "data_sufficiency": 0.88, "n_excluded": 0, "n_alternatives": 0, "n_limitations": 0}


def bundle(agreements, off=(), cluster=(), **more):
    row = BASE | more
    for f in v.FAMILIES:
        row |= {f"{f}_agreement": float(agreements.get(f, 0.0)), f"{f}_available": f in agreements and f not in off, f"{f}_cluster": f in cluster}
    return row


FULL = dict.fromkeys(v.FAMILIES, 1.0)
CASES = [
    ("all agree", bundle(FULL), "L4_control_differenced", "CORROBORATED", "no_action"),
    ("no controls", bundle(FULL, off=("control",)), "L3_multi_indicator", "CORROBORATED", "no_action"),
    ("type stops at L3", bundle(FULL, type="percolation_tank"), "L3_multi_indicator", "CORROBORATED", "no_action"),
    ("two agree", bundle({"terrain": 1.0, "photo": 0.8}), "L2_corroborated", "CORROBORATED", "confirm_next_cycle"),
    ("one agrees", bundle({"photo": 0.8}), "L1_observed", "CORROBORATED", "confirm_next_cycle"),
    ("nothing seen", bundle({}), "L0_recorded", "INCONCLUSIVE", "data_quality_fix"),
    ("too little data", bundle(FULL, data_sufficiency=0.2), "N1_inconclusive", "INCONCLUSIVE", "confirm_next_cycle"),
    ("broken record", bundle({"terrain": 0.1}, metadata_integrity=0.4), "N1_inconclusive", "INCONCLUSIVE", "recapture_geotag"),
    ("absent, nothing excluded", bundle({"satellite": -1.0, "temporal": -1.0}), "N2_unsupported", "UNSUPPORTED", "physical_verification"),
    ("absent and excluded", bundle({"satellite": -1.0, "temporal": -1.0}, n_excluded=1), "N3_contradicted", "CONTRADICTED", "physical_verification"),
    ("terrain path", bundle({"terrain": -1.0, "satellite": -0.5}, cluster=("satellite",), detectability_passed=False, escalated=True, n_excluded=1, type="farm_pond"), "N3_contradicted", "CONTRADICTED", "physical_verification"),
    ("terrain caps", bundle(FULL | {"terrain": -1.0}), "L2_corroborated", "CORROBORATED", "confirm_next_cycle"),
    ("conflict", bundle({"terrain": 1.0, "satellite": -1.0, "temporal": 1.0, "control": -1.0}), "N1_inconclusive", "INCONCLUSIVE", "confirm_next_cycle"),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [{"name": n, **b} for n, b, *_ in CASES]
    return {r["name"]: r for r in reconcile(spark.createDataFrame(rows)).collect()}


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_declared(verdicts, case):
    name, _, level, label, action = case
    found = verdicts[name]
    assert (found["level"], found["label"], found["action"]) == (level, label, action), found["rule_path"]
    assert found["dissent"]


def test_epsilon_counts_for_weight_not_support(spark):
    row = reconcile(spark.createDataFrame([bundle({"terrain": 0.04, "satellite": 1.0})])).first()
    assert row["support"] == 0.2 and row["weight_total"] == 0.45


def test_unknown_type_is_an_error(spark):
    with pytest.raises(Exception, match="no expectations"):
        reconcile(spark.createDataFrame([bundle(FULL, type="moat")])).collect()


def test_random_bundles(spark):
    random.seed(3)
    rows = [bundle({f: random.uniform(-1, 1) for f in v.FAMILIES}, off=random.sample(v.FAMILIES, random.randint(0, 6)), cluster=random.sample(v.FAMILIES, 2), type=random.choice(v.WORKS).name, detectability_passed=random.random() < 0.5, escalated=random.random() < 0.5, metadata_integrity=random.random(), data_sufficiency=random.random(), n_excluded=random.randint(0, 2)) for _ in range(400)]
    found = invariants(reconcile(spark.createDataFrame(rows))).collect()
    assert len(found) == 400 and not [r for r in found if r["broken"]]
    for r in found:
        on = [f for f in v.FAMILIES if r[f"{f}_available"]]
        total = sum(v.WEIGHTS[f] for f in on)
        support = sum(v.WEIGHTS[f] * r[f"{f}_agreement"] for f in on if abs(r[f"{f}_agreement"]) >= 0.05)
        assert abs(r["score"] - support / max(total, 1e-9)) < 1e-9
        assert (r["level"] == "N3_contradicted") <= (r["n_excluded"] > 0)
