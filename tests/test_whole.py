"""Queries over all their rows, against brute force on the smallest tables."""

import collections
import math
import pathlib

import __spark_entry__ as entry
import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest


@pytest.fixture(scope="module")
def run(spark, small):
    return lambda name: [r.asDict() for r in entry.queries()[name](spark, small).collect()]


def table(small, name):
    return pq.read_table(f"{small}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def series(small):
    """Each user's values in order of their events."""
    found = collections.defaultdict(list)
    for e in sorted(table(small, "events"), key=lambda e: e["event_id"]):
        found[e["user_id"]].append((e["event_id"], e["value"]))
    return found


def nearest(x):
    """Rounded half away from zero, as Spark and the SQL round."""
    return math.copysign(math.floor(abs(x) + 0.5), x)


def pairs(points):
    return [(p, q) for i, p in enumerate(points) for q in points[i + 1 :]]


def test_trends_use_every_event(run, series):
    found, p_values = {r["user_id"]: r for r in run("prd_14")}, {r["user_id"]: r for r in run("mth_09")}
    assert found.keys() == p_values.keys() == {u for u, points in series.items() if len(points) >= 5}
    for user, row in found.items():
        values = [nearest(x) for _, x in series[user]]
        n, s = len(values), sum((y > x) - (y < x) for x, y in pairs(values))
        var = (n * (n - 1) * (2 * n + 5) - sum(c * (c - 1) * (2 * c + 5) for c in collections.Counter(values).values())) / 18
        z = (s - (s > 0) + (s < 0)) / math.sqrt(var) if var > 0 else 0.0
        assert (row["n"], row["s"]) == (n, s)
        assert row["var_s"] == pytest.approx(var) and row["z"] == pytest.approx(z)
        assert p_values[user]["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-9)


@pytest.mark.parametrize(("name", "of"), [("prd_15", nearest), ("mth_10", float)])
def test_slopes_use_every_event(run, series, name, of):
    found = {r["user_id"]: r["slope"] for r in run(name)}
    expected = {u: np.median([(of(y) - of(x)) / (b - a) for (a, x), (b, y) in pairs(points)]) for u, points in series.items() if len(points) > 1}
    assert found == pytest.approx(expected)


def test_signs_use_every_event(run, series):
    expected = {u: sum((y > x) - (y < x) for (_, x), (_, y) in pairs(points)) for u, points in series.items() if len(points) > 1}
    assert {r["user_id"]: r["s"] for r in run("joi_17")} == expected


TOLERANCES = {"slope_mismatch": ("slope", 2), "lulc_mismatch": ("lulc", 0), "elevation_mismatch": ("elevation", 50)}


def reason_of(site, c):
    if c["near"] < 250:
        return "too_close_to_intervention"
    if c["buffer"]:
        return "inside_command_buffer"
    for name, (key, most) in TOLERANCES.items():
        if abs(c[key] - site[key]) > most:
            return name
    if site["channel"] and c["order"] != site["order"]:
        return "strahler_mismatch"
    if not site["channel"] and abs(c["stream"] - site["stream"]) > 50:
        return "dist_to_stream_mismatch"
    return "insufficient_data" if c["enough"] < site["enough"] else None


def percentile(values, p):
    values, at = sorted(values), (len(values) - 1) * p
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def controls(larger):
    """(site, control) -> (reason, distance), site -> statuses in walking order, site -> its change, control -> its change."""
    sites = {k: {"slope": k * 3 % 90 / 10, "elevation": 400.0 + k * 7 % 160, "stream": float(k * 13 % 300), "order": k % 4, "lulc": k % 2, "enough": (40 + k % 30) / 100, "channel": k % 3 == 0, "delta": (k * 29 % 61 - 30) / 200} for k in (r["c_custkey"] for r in table(larger, "customer"))}
    others = {k: {"slope": k * 7 % 90 / 10, "elevation": 400.0 + k * 13 % 160, "stream": float(k * 29 % 300), "order": k % 4, "lulc": k % 2, "enough": (50 + k * 3 % 50) / 100, "near": k * 61 % 2000, "buffer": k % 19 == 0, "cell": (k * 211 % 4000 // 500, k * 97 % 3000 // 500), "delta": (k * 17 % 41 - 20) / 200} for k in (r["s_suppkey"] for r in table(larger, "supplier"))}
    matched, walked = {}, {}
    for k, site in sites.items():
        for j, c in others.items():
            if k // 1500 == j // 100:
                d = [(site["slope"] - c["slope"]) / 2, (site["elevation"] - c["elevation"]) / 50, (site["stream"] - c["stream"]) / 50]
                matched[k, j] = reason_of(site, c), math.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
        cells, walked[k] = collections.Counter(), {}
        for _, j in sorted((matched[k, j][1], j) for j in others if (k, j) in matched and matched[k, j][0] is None):
            full = sum(cells.values()) >= 12
            walked[k][j] = "beyond_max_controls" if full else "spatial_cell_full" if cells[others[j]["cell"]] >= 3 else "selected"
            cells[others[j]["cell"]] += walked[k][j] == "selected"
    return matched, walked, {k: x["delta"] for k, x in sites.items()}, {k: x["delta"] for k, x in others.items()}


@pytest.fixture(scope="module")
def run_larger(spark, larger):
    return lambda name: [r.asDict() for r in entry.queries()[name](spark, larger).collect()]


def test_every_site_is_matched(run_larger, controls):
    matched, walked, *_ = controls
    alive = {k: d for k, (reason, d) in matched.items() if reason is None}
    key = lambda r: (r["claim_id"], r["control_id"])
    assert {key(r): r["reason"] for r in run_larger("flt_11")} == {k: reason for k, (reason, _) in matched.items()}
    assert {key(r): r["distance"] for r in run_larger("joi_16")} == pytest.approx(alive)
    assert {r["reason"]: r["n"] for r in run_larger("agg_21")} == collections.Counter(reason or "none" for reason, _ in matched.values())
    assert {key(r): r["status"] for r in run_larger("win_07")} == {(k, j): x for k, found in walked.items() for j, x in found.items()}
    assert {key(r): r["place"] for r in run_larger("srt_05")} == {(k, j): i for k, found in walked.items() for i, j in enumerate(found, 1)}


def test_every_site_is_compared(run_larger, controls):
    _, walked, site_delta, delta = controls
    chosen = {k: [delta[j] for j, x in found.items() if x == "selected"] for k, found in walked.items()}
    assert {r["claim_id"]: (r["n_selected"], r["insufficient"]) for r in run_larger("prd_12")} == {k: (len(x), len(x) < 5) for k, x in chosen.items()}
    compared = {r["claim_id"]: r for r in run_larger("prd_13")}
    family = {r["claim_id"]: (r["available"], r["agreement"]) for r in run_larger("prd_11")}
    assert compared.keys() == {k for k, x in chosen.items() if len(x) >= 5} and family.keys() == chosen.keys()
    assert compared
    for k, x in chosen.items():
        if k not in compared:
            assert family[k] == (False, 0.0)
            continue
        median, low, high = (percentile(x, p) for p in (0.5, 0.1, 0.9))
        moved, row = site_delta[k] - median, compared[k]
        assert [row[f"{c}_e9"] / 1e9 for c in ("median", "p10", "p90", "differenced")] == pytest.approx([median, low, high, moved], abs=2e-9)
        assert row["n_controls"] == len(x) and row["exceeds_all"] == (site_delta[k] > max(x))
        assert row["site_percentile"] == pytest.approx(sum(y < site_delta[k] for y in x) / len(x) * 100)
        size = math.copysign(min(1, abs(moved) / 0.08), moved) * (1 if not low <= site_delta[k] <= high else 0.5)
        assert family[k] == (True, pytest.approx(0.0 if abs(moved) < 0.02 else size, abs=5.1e-5))


@pytest.fixture(scope="module")
def other(larger):
    connection = duckdb.connect()
    for path in pathlib.Path(larger).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def same_rows(spark, larger, other, name, statement):
    found = entry.queries()[name](spark, larger)
    other.register("found", found.toArrow())
    columns = ", ".join(found.columns)
    other.execute(f"CREATE OR REPLACE TABLE expected AS SELECT {columns} FROM ({statement})")
    for one, two in (("expected", "found"), ("found", "expected")):
        assert other.execute(f"SELECT {columns} FROM {one} EXCEPT ALL SELECT {columns} FROM {two} LIMIT 3").fetchall() == []


@pytest.mark.parametrize("name", ["rm_04", "rm_07", "stm_01", "src_03", "src_04", "src_06", "win_05", "win_08", "joi_15", "eng_16", "joi_10"])
def test_whole_tables_beside_their_sql(spark, larger, other, name):
    assert entry.queries()[name](spark, larger).limit(1).count() == 1
    same_rows(spark, larger, other, name, entry.oracle_sql()[name])


def test_trend_statistics_of_any_length():
    from terravow.functions import trends

    draw = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 64, 257):
        values = np.round(draw.normal(0, 3, n))
        expected = sum(int(y > x) - int(y < x) for i, x in enumerate(values) for y in values[i + 1 :])
        assert trends.sign_sum(values) == expected
    at, values = np.sort(draw.choice(10**6, 3001, replace=False)).astype("f8"), np.round(draw.normal(0, 3, 3001))
    i, j = np.triu_indices(3001, 1)
    assert trends.median_slope(at, values) == np.median((values[j] - values[i]) / (at[j] - at[i]))
    assert trends.median_slope(at, np.zeros(3001)) == 0.0


def test_other_configurations_are_refused_or_told_apart():
    from terravow.functions.vocabulary import Config

    assert Config().text() != Config(epsilon=0.2).text()
    for wrong in ({"agreeing": -0.1}, {"epsilon": 0.9}, {"weights": (("terrain", 1.0),)}):
        with pytest.raises(ValueError):
            Config(**wrong)
