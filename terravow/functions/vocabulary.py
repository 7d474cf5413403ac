"""Closed vocabularies and constants of the evidence model, and small dimension tables made from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Families in engine order, their weights, levels, labels.
FAMILIES = ("terrain", "satellite", "temporal", "photo", "control", "context")
DISPLAY_ORDER = ("terrain", "satellite", "temporal", "control", "context", "photo")
INDEPENDENT = tuple(f for f in FAMILIES if f != "photo")
WEIGHTS = {"terrain": 0.25, "satellite": 0.20, "temporal": 0.20, "photo": 0.12, "control": 0.15, "context": 0.08}
WEIGHT_SUM = 0.25 + 0.20 + 0.20 + 0.15 + 0.12 + 0.08
POSITIVE = ("L0_recorded", "L1_observed", "L2_corroborated", "L3_multi_indicator", "L4_control_differenced")
LEVELS = ("L4_control_differenced", "L3_multi_indicator", "L2_corroborated", "L1_observed", "L0_recorded", "N1_inconclusive", "N2_unsupported", "N3_contradicted")
SEVERITY = {"N3_contradicted": 1, "N2_unsupported": 2, "N1_inconclusive": 3, "L0_recorded": 4, "L1_observed": 5}
RANKED_BY_CONFIDENCE = ("N3_contradicted", "N2_unsupported")

# Thresholds of the engine.
EPSILON, AGREEING, DISAGREEING = 0.05, 0.35, -0.35
L4_COVERAGE, MIN_SUFFICIENCY, N2_SCORE, PARTIAL, CORROBORATED = 0.70, 0.35, -0.15, 0.15, 0.35
CATEGORICAL = -1.0
L3_FAMILIES, L2_FAMILIES, N3_DISAGREEING = 3, 2, 2
BADGE = 0.15

# Thresholds of the evidence producers.
PIXEL_AREA, MIN_PIXELS, CLUSTER_RADIUS, CLUSTER_MEMBERS = 900.0, 1.5, 500.0, 3
NOISE, FULL_DELTA, STRONG_SIGNAL, MIN_USABLE = 0.02, 0.08, 0.20, 0.35
SEASON_WEIGHT = {"rabi": 1.0, "summer": 0.9, "kharif": 0.4}
MAX_CONTROLS, MIN_CONTROLS, PER_CELL, CELL_M = 12, 5, 3, 500.0
ANOMALY, STRONG_ANOMALY = 0.25, 0.50


@dataclass(frozen=True)
class Config:
    """Every threshold of the engine; verdicts can be made under another set and tell which by its digest."""

    weights: tuple[tuple[str, float], ...] = tuple(WEIGHTS.items())
    epsilon: float = EPSILON
    agreeing: float = AGREEING
    disagreeing: float = DISAGREEING
    l4_coverage: float = L4_COVERAGE
    l3_families: int = L3_FAMILIES
    l2_families: int = L2_FAMILIES
    n3_disagreeing: int = N3_DISAGREEING
    min_sufficiency: float = MIN_SUFFICIENCY
    categorical: float = CATEGORICAL
    n2_score: float = N2_SCORE
    partial: float = PARTIAL
    corroborated: float = CORROBORATED

    def __post_init__(self) -> None:
        if {name for name, _ in self.weights} != set(FAMILIES) or any(w < 0 for _, w in self.weights):
            raise ValueError("every family has one weight, not below zero")
        if not (-1 <= self.disagreeing < 0 < self.agreeing <= 1 and 0 <= self.epsilon <= self.agreeing):
            raise ValueError("thresholds of agreement lie on both sides of zero")

    @property
    def weight(self) -> dict[str, float]:
        return dict(self.weights)

    @property
    def weight_sum(self) -> float:
        return WEIGHT_SUM if self.weight == WEIGHTS else sum(w for _, w in self.weights)

    def text(self) -> str:
        """All settings in the order of their names, for a digest."""
        return ";".join(f"{k}={x!r}" for k, x in sorted({**vars(self), "weights": sorted(self.weights)}.items()))


@dataclass(frozen=True)
class Work:
    """What is expected of one type of work."""

    name: str
    rises: tuple[str, ...]
    falls: tuple[str, ...]
    footprint: tuple[float, float]
    ceiling: int  # position in POSITIVE
    optical: bool
    noted: bool  # carries a type limitation


# The 18 types of work, their expected indices, footprints in square metres and ceilings.
WORKS = (
    Work("check_dam", ("MNDWI", "water_persistence_months", "NDVI_rabi_command"), (), (1000.0, 10000.0), 4, True, False),
    Work("percolation_tank", ("MNDWI", "NDVI_rabi_buffer", "NDVI_summer_buffer"), (), (2000.0, 20000.0), 3, True, True),
    Work("farm_pond", ("MNDWI", "NDVI_rabi_parcel"), (), (400.0, 2500.0), 3, True, True),
    Work("nala_bund", ("MNDWI", "water_persistence_months"), (), (800.0, 8000.0), 3, True, False),
    Work("earthen_bund", ("NDVI", "NDMI"), ("BSI",), (5000.0, 40000.0), 3, True, True),
    Work("contour_bund", ("NDVI", "NDMI"), ("BSI",), (5000.0, 40000.0), 3, True, False),
    Work("contour_trench", ("NDVI", "NDMI"), ("BSI",), (1.0, 3.0), 3, True, True),
    Work("staggered_trench", ("NDVI", "NDMI"), ("BSI",), (1.0, 3.0), 3, True, False),
    Work("gully_plug", ("NDVI",), ("BSI",), (20.0, 200.0), 2, True, True),
    Work("plantation", ("NDVI",), ("BSI",), (10000.0, 100000.0), 4, True, True),
    Work("horticulture", ("NDVI",), (), (5000.0, 50000.0), 4, True, False),
    Work("waterbody_renovation", ("water_persistence_months", "max_water_extent", "MNDWI"), (), (5000.0, 100000.0), 4, True, True),
    Work("recharge_shaft", (), (), (4.0, 25.0), 1, False, True),
    Work("dug_well", (), (), (4.0, 80.0), 1, False, True),
    Work("borewell", (), (), (0.1, 1.0), 1, False, True),
    Work("livestock", (), (), (0.0, 0.0), 0, False, True),
    Work("livelihood", (), (), (0.0, 0.0), 0, False, True),
    Work("other", (), (), (100.0, 1000.0), 1, False, True),
)


@dataclass(frozen=True)
class Siting:
    """Limits of a type's site; None where there is no such limit. Slopes are (low, high, unit)."""

    name: str
    min_order: int | None = None
    max_order: int | None = None
    slope: tuple[float | None, float | None, str] | None = None
    max_stream: float | None = None
    min_stream: float | None = None
    min_flow: float | None = None
    max_flow: float | None = None
    depression: bool = False


# Siting limits; the other types have none.
SITINGS = (
    Siting("check_dam", min_order=2, slope=(None, 5.0, "degrees"), max_stream=30.0, min_flow=100.0),
    Siting("percolation_tank", min_order=2, slope=(None, 5.0, "percent"), depression=True, max_stream=150.0),
    Siting("farm_pond", slope=(None, 8.0, "percent"), max_stream=250.0, min_flow=5.0),
    Siting("nala_bund", min_order=2, max_stream=30.0, min_flow=100.0),
    Siting("earthen_bund", slope=(1.0, 15.0, "percent"), min_stream=20.0),
    Siting("contour_bund", slope=(1.0, 15.0, "percent"), min_stream=20.0),
    Siting("contour_trench", slope=(5.0, 33.0, "percent"), max_flow=5000.0),
    Siting("staggered_trench", slope=(5.0, 33.0, "percent"), max_flow=5000.0),
    Siting("gully_plug", min_order=1, max_order=2, slope=(3.0, None, "percent"), max_stream=50.0),
    Siting("plantation", min_stream=10.0),
    Siting("horticulture", slope=(None, 20.0, "percent"), min_stream=10.0),
    Siting("waterbody_renovation", depression=True, slope=(None, 5.0, "percent")),
)

# Roles, what they may do, and where they work.
CAPABILITIES = {
    "WDT": ("claim_read", "claim_create", "evidence_read", "verdict_read"),
    "PIA": ("claim_read", "claim_create", "evidence_read", "verdict_read"),
    "WCDC": ("claim_read", "evidence_read", "verdict_read", "verdict_recompute", "adjudication_create", "ledger_verify"),
    "SLNA": ("claim_read", "evidence_read", "verdict_read", "verdict_recompute", "adjudication_create", "ledger_verify"),
    "DOLR_ADMIN": ("claim_read", "evidence_read", "verdict_read", "ledger_verify", "user_manage", "district_manage"),
    "READONLY": ("claim_read", "evidence_read", "verdict_read", "ledger_verify"),
}
WORKSPACES = {"WDT": "field", "PIA": "field", "WCDC": "monitoring", "SLNA": "monitoring", "READONLY": "monitoring", "DOLR_ADMIN": "administration"}
BANDS = {"N3_contradicted": "verify", "N2_unsupported": "verify", "N1_inconclusive": "wait", "L0_recorded": "wait", "L1_observed": "wait", "L2_corroborated": "done", "L3_multi_indicator": "done", "L4_control_differenced": "done"}


def works(spark: SparkSession) -> DataFrame:
    """One row a type; 18 rows."""
    rows = [(i, w.name, list(w.rises), list(w.falls), w.footprint[0], w.footprint[1], w.ceiling, w.optical, w.noted) for i, w in enumerate(WORKS)]
    return spark.createDataFrame(rows, "type_index int, type string, rises array<string>, falls array<string>, footprint_min double, footprint_max double, ceiling int, optical boolean, noted boolean")


def levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, i, SEVERITY.get(n), BANDS[n]) for i, n in enumerate(LEVELS)], "level string, ladder int, severity int, band string")
