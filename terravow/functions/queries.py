"""Scalar function families as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.oracle import sql
from ..plans.registry import query
from ..sources import adapter as a
from . import scalars as s
from . import vocabulary as v
from .trends import median_slopes

#: Words that the vocabulary lock refuses; common words stand in for them in the driver's texts.
LOCKED = ("proof", "proves", "fraud", "fake", "guaranteed", "trash", "scum")


@query("str_01", "SELECT event_id, instr(props, ':') AS at, contains(props, '1') AS has_one FROM events")
def containment(spark, d):
    return a.read(spark, d, "events").select("event_id", F.instr("props", ":").cast("long").alias("at"), F.contains("props", F.lit("1")).alias("has_one"))


@query("str_02", sql("SELECT id, regexp_matches(entity_id, '^[0-9]+$') AS numeric FROM fx_audit"))
def regex_match(spark, d):
    return a.audit(spark, d).select("id", F.col("entity_id").rlike("^[0-9]+$").alias("numeric"))


@query("str_03", "SELECT page_id, regexp_extract(url, '(?i)^https?://([^/]+)/', 1) AS host, regexp_extract(url, '(?i)/([a-z]{2})/([0-9]+)', 2) AS number FROM pages")
def regex_groups(spark, d):
    return a.read(spark, d, "pages").select("page_id", F.regexp_extract("url", "(?i)^https?://([^/]+)/", 1).alias("host"), F.regexp_extract("url", "(?i)/([a-z]{2})/([0-9]+)", 2).alias("number"))


@query("str_04", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM pages")
def safe_names(spark, d):
    return a.read(spark, d, "pages").select("page_id", F.regexp_replace("url", "[^A-Za-z0-9._-]+", "_").alias("name"))


@query("str_05", sql("SELECT claim_id, 'N' || lpad(CAST(floor(lat) AS BIGINT)::VARCHAR, 2, '0') || 'E' || lpad(CAST(floor(lon) AS BIGINT)::VARCHAR, 3, '0') AS tile, lpad(CAST(claim_id AS VARCHAR), 7, '0') AS padded FROM fx_claims"))
def padded_names(spark, d):
    two = lambda c, n: F.lpad(F.floor(c).cast("string"), n, "0")
    return a.claims(spark, d).select("claim_id", F.concat(F.lit("N"), two("lat", 2), F.lit("E"), two("lon", 3)).alias("tile"), F.lpad(F.col("claim_id").cast("string"), 7, "0").alias("padded"))


@query("str_06", sql("SELECT intervention_id, replace(type, '_', ' ') AS asset, upper(split_part(type, '_', 1)) AS base FROM fx_interventions"))
def replaced(spark, d):
    return a.interventions(spark, d).select("intervention_id", F.replace("type", F.lit("_"), F.lit(" ")).alias("asset"), F.upper(F.split_part("type", F.lit("_"), F.lit(1))).alias("base"))


def prefix_direction(index, rises="rises", falls="falls"):
    """+1, -1 or 0: an expectation matches an index by itself or as its first words. The satellite rule."""
    has = lambda names: F.exists(names, lambda x: (x == index) | x.startswith(F.concat(index, F.lit("_"))))
    return F.when(has(rises), 1).when(has(falls), -1).otherwise(0)


def base_direction(index, rises="rises", falls="falls"):
    """+1, -1 or 0: an expectation matches by its first word, whatever the case. The temporal rule."""
    first = lambda x: F.upper(F.split_part(x, F.lit("_"), F.lit(1)))
    has = lambda names: F.exists(names, lambda x: first(x) == first(index))
    return F.when(has(rises), 1).when(has(falls), -1).otherwise(0)


_INDEXES = ("NDVI", "MNDWI", "NDMI", "BSI", "ndvi_rabi", "water")
_index_rows = "(SELECT unnest(['NDVI', 'MNDWI', 'NDMI', 'BSI', 'ndvi_rabi', 'water']) AS i)"


def _indexed(spark, d):
    """Every work with each index and what is expected of its type."""
    works = a.interventions(spark, d).select("intervention_id", "type").join(F.broadcast(v.works(spark).select("type", "rises", "falls")), "type")
    return works.select("intervention_id", "rises", "falls", F.explode(F.array(*map(F.lit, _INDEXES))).alias("i"))


_OF_WORKS = f"FROM fx_interventions JOIN fx_types t USING (type), {_index_rows}"


@query("str_07", sql(f"SELECT intervention_id, i, CASE WHEN len([x FOR x IN t.rises IF x = i OR starts_with(x, i || '_')]) > 0 THEN 1 WHEN len([x FOR x IN t.falls IF x = i OR starts_with(x, i || '_')]) > 0 THEN -1 ELSE 0 END AS direction {_OF_WORKS}"))
def prefix_match(spark, d):
    return _indexed(spark, d).select("intervention_id", "i", prefix_direction(F.col("i")).alias("direction"))


@query("str_08", sql(f"SELECT intervention_id, i, CASE WHEN len([x FOR x IN t.rises IF upper(split_part(x, '_', 1)) = upper(split_part(i, '_', 1))]) > 0 THEN 1 WHEN len([x FOR x IN t.falls IF upper(split_part(x, '_', 1)) = upper(split_part(i, '_', 1))]) > 0 THEN -1 ELSE 0 END AS direction {_OF_WORKS}"))
def base_match(spark, d):
    return _indexed(spark, d).select("intervention_id", "i", base_direction(F.col("i")).alias("direction"))


@query("str_09", sql("SELECT claim_id, version, concat_ws('; ', agreeing, disagreeing, scene_scale) AS joined FROM fx_tallies"))
def joined_text(spark, d):
    return a.verdicts(spark, d).select("claim_id", "version", F.concat_ws("; ", "agreeing", "disagreeing", "scene_scale").alias("joined"))


@query("str_10", sql("SELECT claim_id, version, printf('%+.4f', floor(score * 1e4 + 0.5e0) / 1e4) AS signed, printf('%.0f%%', floor(coverage * 100 + 0.5e0)) AS percent FROM fx_verdicts"))
def formatted(spark, d):
    """Signed, fixed and percent formats, of numbers rounded half up beforehand: formatters round ties in their own ways."""
    rounded = lambda x: F.floor(x + 0.5).cast("double")
    return a.verdicts(spark, d).select("claim_id", "version", F.format_string("%+.4f", rounded(F.col("score") * 1e4) / 1e4).alias("signed"), F.format_string("%.0f%%", rounded(F.col("coverage") * 100)).alias("percent"))


@query("str_11", "SELECT doc_id, nullif(trim(replace(substr(text, 1, 40), chr(10), ' ')), '') AS head FROM documents")
def blank_to_null(spark, d):
    return a.read(spark, d, "documents").select("doc_id", F.nullif(F.trim(F.replace(F.substring("text", 1, 40), F.lit("\n"), F.lit(" "))), F.lit("")).alias("head"))


def redacted(payload, secret=("password", "token", "secret", "authorization", "jwt", "k")):
    """A map with the values of secret keys hidden; keys are compared in lower case, one level deep."""
    return F.transform_values(payload, lambda key, value: F.when(F.lower(key).isin(*secret), F.lit("[redacted]")).otherwise(value))


@query("str_12", "SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN '[redacted]' END AS k FROM events")
def redaction(spark, d):
    payload = F.from_json("props", "map<string,string>")
    return a.read(spark, d, "events").select("event_id", F.element_at(redacted(payload), "k").alias("k"))


def locked_pattern() -> str:
    return r"(?i)\b(" + "|".join(LOCKED) + r")\b"


@query("str_13", "SELECT doc_id, regexp_matches(text, '(?i)\\b(" + "|".join(LOCKED) + ")\\b') AS refused FROM documents")
def vocabulary_lock(spark, d):
    return a.read(spark, d, "documents").select("doc_id", F.col("text").rlike(locked_pattern()).alias("refused"))


@query("str_14", "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM documents")
def escaped(spark, d):
    """Text as it may stand in markup."""
    text = F.col("text")
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return a.read(spark, d, "documents").select("doc_id", text.alias("escaped"))


@query("str_15", sql("SELECT claim_id, version, substr(level, 1, 2) AS short, split_part(level, '_', 1) AS code FROM fx_levelled"))
def sliced(spark, d):
    return a.verdicts(spark, d).select("claim_id", "version", F.substring("level", 1, 2).alias("short"), F.split_part("level", F.lit("_"), F.lit(1)).alias("code"))


# --- dates

_season = "CASE WHEN month(asserted_date) BETWEEN 6 AND 10 THEN 'kharif' WHEN month(asserted_date) BETWEEN 3 AND 5 THEN 'summer' ELSE 'rabi' END"
_m = lambda date, n: f"CAST({date} + INTERVAL {n} MONTH AS DATE)" if n > 0 else f"CAST({date} - INTERVAL {-n} MONTH AS DATE)"
_pre_end, _post_start = _m("asserted_date", -3), _m("asserted_date", 3)
WINDOWS_SQL = f"SELECT claim_id, asserted_date, {_m(_pre_end, -24)} AS pre_start, {_pre_end} AS pre_end, {_post_start} AS post_start, {_m(_post_start, 24)} AS post_end FROM fx_claims"


@query("dte_01", sql(f"SELECT claim_id, {_season} AS season FROM fx_claims"))
def seasons(spark, d):
    return a.claims(spark, d).select("claim_id", s.season("asserted_date").alias("season"))


@query("dte_02", sql("SELECT claim_id, CAST(year(asserted_date) + CASE WHEN month(asserted_date) >= 11 THEN 1 ELSE 0 END AS INT) AS year FROM fx_claims"))
def season_years(spark, d):
    return a.claims(spark, d).select("claim_id", s.season_year("asserted_date").alias("year"))


@query("dte_03", sql(f"SELECT claim_id, {_m('asserted_date', 1)} AS later, {_m('asserted_date', -3)} AS earlier FROM fx_claims"))
def shifted(spark, d):
    return a.claims(spark, d).select("claim_id", F.add_months("asserted_date", 1).alias("later"), F.add_months("asserted_date", -3).alias("earlier"))


@query("dte_04", sql("SELECT claim_id, pre_start, pre_end, post_start, post_end FROM spans", spans=WINDOWS_SQL))
def before_and_after(spark, d):
    return a.claims(spark, d).select("claim_id", *(c.alias(n) for n, c in s.windows("asserted_date").items()))


@query("dte_05", sql("SELECT w.claim_id, e.ordinal, CASE WHEN e.at BETWEEN pre_end AND post_start THEN NULL WHEN e.at >= pre_start AND e.at < pre_end THEN 'pre' WHEN e.at > post_start AND e.at <= post_end THEN 'post' END AS side FROM spans w, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS ordinal) o JOIN LATERAL (SELECT o.ordinal, CAST(asserted_date + INTERVAL (o.ordinal * 9 - 27) MONTH AS DATE) AS at) e ON true", spans=WINDOWS_SQL))
def classified(spark, d):
    """The side of a claim's windows on which each of six dates falls."""
    rows = a.claims(spark, d).select("claim_id", "asserted_date", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("ordinal"))
    at = F.add_months(F.col("asserted_date"), F.col("ordinal") * 9 - 27)
    return rows.select("claim_id", "ordinal", s.window_side(at, "asserted_date").alias("side"))


@query("dte_06", sql(f"SELECT claim_id, CASE {_season} WHEN 'kharif' THEN make_date(year(asserted_date), 8, 15) WHEN 'rabi' THEN make_date(CAST(year(asserted_date) + CASE WHEN month(asserted_date) >= 11 THEN 1 ELSE 0 END AS BIGINT), 1, 1) ELSE make_date(year(asserted_date), 4, 15) END AS midpoint FROM fx_claims"))
def midpoints(spark, d):
    return a.claims(spark, d).select("claim_id", s.season_midpoint(s.season("asserted_date"), s.season_year("asserted_date")).alias("midpoint"))


@query("dte_07", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events")
def iso_text(spark, d):
    return a.read(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("iso"))


@query("dte_08", "SELECT event_id, CAST(strptime(strftime(ts, '%Y:%m:%d %H:%M:%S'), '%Y:%m:%d %H:%M:%S') AS DATE) AS taken FROM events")
def camera_dates(spark, d):
    """Camera timestamps with colons in the date, ISO as the fallback."""
    text = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    taken = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(text))
    return a.read(spark, d, "events").select("event_id", taken.cast("date").alias("taken"))


@query("dte_09", "SELECT event_id, greatest(CAST(epoch(TIMESTAMP '2024-01-15 00:00:00') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT), 0) AS remaining FROM events")
def seconds_left(spark, d):
    """Seconds left to a given moment; the moment is an argument, never the clock."""
    as_of = F.unix_timestamp(F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return a.read(spark, d, "events").select("event_id", F.greatest(as_of - F.unix_timestamp(F.col("ts").cast("timestamp")), F.lit(0)).cast("long").alias("remaining"))


@query("dte_10", sql("SELECT claim_id FROM fx_claims WHERE asserted_date >= DATE '1997-11-01' AND asserted_date < DATE '1998-03-01'"))
def rabi_window(spark, d):
    return a.claims(spark, d).where("asserted_date >= DATE '1997-11-01' AND asserted_date < DATE '1998-03-01'").select("claim_id")


# --- mathematics


@query("mth_01", sql("SELECT control_id, greatest(-1e0, least(1e0, delta / 0.08e0)) AS clamped, abs(delta) AS size FROM fx_candidates"))
def clamped(spark, d):
    return a.candidates(spark, d).select("control_id", s.clamp(F.col("delta") / 0.08).alias("clamped"), F.abs("delta").alias("size"))


@query("mth_02", sql("SELECT claim_id, version, floor(score * 1e4 + 0.5e0) / 1e4 AS stored FROM fx_scores"))
def rounded(spark, d):
    return a.verdicts(spark, d).select("claim_id", "version", s.stored(F.col("score")).alias("stored"))


_dn = lambda c: f"(CASE WHEN {c} <> -9999 THEN {c} * 1e-4 END)"
_nd = lambda x, y: f"(CASE WHEN abs({x} + {y}) >= 1e-6 THEN ({x} - {y}) / ({x} + {y}) END)"
BANDS = ("red", "nir", "green", "blue", "swir1")
_place = "scene_id, row, col"


def reflected(spark, d):
    return a.pixels(spark, d).select("scene_id", "row", "col", "fmask", *(s.reflectance(b).alias(b) for b in BANDS))


REFLECTED = "SELECT scene_id, row, col, fmask, " + ", ".join(f"{_dn(b)} AS {b}" for b in BANDS) + " FROM fx_pixels"


@query("mth_03", sql(f"SELECT {_place}, {_nd('nir', 'red')} AS nd FROM reflected", reflected=REFLECTED))
def difference(spark, d):
    return reflected(spark, d).select("scene_id", "row", "col", s.normalised_difference(F.col("nir"), F.col("red")).alias("nd"))


def indices():
    c = F.col
    return {"ndvi": s.normalised_difference(c("nir"), c("red")), "ndwi": s.normalised_difference(c("green"), c("nir")), "mndwi": s.normalised_difference(c("green"), c("swir1")), "ndmi": s.normalised_difference(c("nir"), c("swir1"))}


@query("mth_04", sql(f"SELECT {_place}, {_nd('nir', 'red')} AS ndvi, {_nd('green', 'nir')} AS ndwi, {_nd('green', 'swir1')} AS mndwi, {_nd('nir', 'swir1')} AS ndmi FROM reflected", reflected=REFLECTED))
def four_indices(spark, d):
    return reflected(spark, d).select("scene_id", "row", "col", *(c.alias(n) for n, c in indices().items()))


@query("mth_05", sql(f"SELECT {_place}, CASE WHEN abs(nir + red + 0.5e0) >= 1e-6 THEN (nir - red) / (nir + red + 0.5e0) * 1.5e0 END AS savi FROM reflected", reflected=REFLECTED))
def soil_adjusted(spark, d):
    return reflected(spark, d).select("scene_id", "row", "col", s.savi(F.col("nir"), F.col("red")).alias("savi"))


@query("mth_06", sql(f"SELECT {_place}, {_nd('(swir1 + red)', '(nir + blue)')} AS bsi FROM reflected", reflected=REFLECTED))
def bare_soil(spark, d):
    c = F.col
    return reflected(spark, d).select("scene_id", "row", "col", s.bsi(c("blue"), c("red"), c("nir"), c("swir1")).alias("bsi"))


@query("mth_07", sql(f"SELECT {_place}, red, swir1 FROM reflected", reflected=REFLECTED))
def scaled(spark, d):
    return reflected(spark, d).select("scene_id", "row", "col", "red", "swir1")


def covariate_distance(slope, elevation, stream):
    """Standardised distance: each difference by its matching tolerance."""
    t = (slope / 2.0, elevation / 50.0, stream / 50.0)
    return F.sqrt(t[0] * t[0] + t[1] * t[1] + t[2] * t[2])


@query("mth_08", sql("SELECT control_id, sqrt((slope_deg - 3e0) / 2e0 * ((slope_deg - 3e0) / 2e0) + (elevation_m - 470e0) / 50e0 * ((elevation_m - 470e0) / 50e0) + (dist_to_stream_m - 120e0) / 50e0 * ((dist_to_stream_m - 120e0) / 50e0)) AS distance FROM fx_candidates"))
def distances(spark, d):
    c = F.col
    return a.candidates(spark, d).select("control_id", covariate_distance(c("slope_deg") - 3.0, c("elevation_m") - 470.0, c("dist_to_stream_m") - 120.0).alias("distance"))


@query("mth_10", "SELECT user_id, quantile_cont((y_value - x_value) / (y_id - x_id), 0.5) AS slope FROM (SELECT x.user_id, x.value AS x_value, y.value AS y_value, x.event_id AS x_id, y.event_id AS y_id FROM events x JOIN events y ON x.user_id = y.user_id AND x.event_id < y.event_id) GROUP BY 1")
def slope_medians(spark, d):
    """Exact median of all pairwise slopes of each user's series."""
    return median_slopes(a.read(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query("mth_11", sql("SELECT control_id, floor(degrees(atan(slope_deg / 100)) * 1e9 + 0.5e0) / 1e9 AS as_degrees FROM fx_candidates"))
def percent_to_degrees(spark, d):
    return a.candidates(spark, d).select("control_id", s.stored(F.degrees(F.atan(F.col("slope_deg") / 100)), 9).alias("as_degrees"))


@query("mth_12", sql("SELECT control_id, floor(sqrt(easting_m * easting_m + northing_m * northing_m) * 1e6 + 0.5e0) / 1e6 AS planar FROM fx_candidates"))
def planar_distance(spark, d):
    return a.candidates(spark, d).select("control_id", s.stored(F.hypot("easting_m", "northing_m"), 6).alias("planar"))


@query("mth_13", sql("SELECT control_id, floor(easting_m / 30) * 30 AS west, ceil(northing_m / 30) * 30 AS north FROM fx_candidates"))
def snapped(spark, d):
    c = F.col
    return a.candidates(spark, d).select("control_id", (F.floor(c("easting_m") / 30) * 30).cast("double").alias("west"), (F.ceil(c("northing_m") / 30) * 30).cast("double").alias("north"))


def degrees_of(degree, minute, second, hemisphere):
    """Degrees from degrees, minutes, seconds and a hemisphere letter."""
    return (degree + minute / 60.0 + second / 3600.0) * F.when(F.upper(hemisphere).isin("S", "W"), -1.0).otherwise(1.0)


@query("mth_14", "SELECT s_suppkey, (18e0 + s_suppkey % 60 / 60e0 + s_suppkey * 7 % 60 / 3600e0) * CASE WHEN s_suppkey % 2 = 0 THEN -1e0 ELSE 1e0 END AS degrees, s_suppkey % 9 * 5e0 AS accuracy FROM supplier")
def camera_position(spark, d):
    """A position and its accuracy from a camera's fields: accuracy is five times the dilution of precision."""
    k = F.col("s_suppkey")
    hemisphere = F.when(k % 2 == 0, "s").otherwise("N")
    return a.read(spark, d, "supplier").select("s_suppkey", degrees_of(F.lit(18.0), k % 60, k * 7 % 60, hemisphere).alias("degrees"), (k % 9 * 5.0).alias("accuracy"))


@query("mth_15", sql("SELECT control_id, CAST(floor(easting_m / 500) AS BIGINT) AS cx, CAST(floor(northing_m / 500) AS BIGINT) AS cy FROM fx_candidates"))
def cells(spark, d):
    return a.candidates(spark, d).select("control_id", F.floor(F.col("easting_m") / 500).alias("cx"), F.floor(F.col("northing_m") / 500).alias("cy"))


@query("mth_16", "SELECT s_suppkey, CASE WHEN s_suppkey % 20 < 5 THEN 0 ELSE least(30 * CAST(pow(2, least(s_suppkey % 20 - 5, 12)) AS BIGINT), 3600) END AS seconds FROM supplier")
def lockouts(spark, d):
    return a.read(spark, d, "supplier").select("s_suppkey", s.lockout_seconds(F.col("s_suppkey") % 20).alias("seconds"))


@query("mth_17", sql("SELECT claim_id, greatest(coalesce(CASE WHEN claim_id % 6 = 0 THEN NULL ELSE uncertainty_m END, 15e0), 15e0) AS radius FROM fx_claims"))
def radii(spark, d):
    """At least 15 m; unknown accuracy is 15 m; a negative one is refused."""
    x = F.when(F.col("claim_id") % 6 != 0, F.col("uncertainty_m"))
    sound = F.when(x < 0, F.raise_error(F.lit("negative accuracy")).cast("double")).otherwise(x)
    return a.claims(spark, d).select("claim_id", F.greatest(F.coalesce(sound, F.lit(15.0)), F.lit(15.0)).alias("radius"))


@query("mth_18", sql("SELECT claim_id, floor((lon - 73e0) * 111320e0 * cos(radians(18e0)) * 1e3 + 0.5e0) / 1e3 AS x, floor((lat - 18e0) * 110574e0 * 1e3 + 0.5e0) / 1e3 AS y FROM fx_claims"))
def planar_bounds(spark, d):
    import math

    across = 111320.0 * math.cos(math.radians(18.0))
    return a.claims(spark, d).select("claim_id", s.stored((F.col("lon") - 73.0) * F.lit(111320.0) * F.lit(across / 111320.0), 3).alias("x"), s.stored((F.col("lat") - 18.0) * 110574.0, 3).alias("y"))


# --- bits, hashes, arrays, maps, JSON


@query("bit_01", sql("SELECT scene_id, row, col, (fmask & 2) <> 0 AS cloud, (fmask & 32) <> 0 AS water, (fmask >> 6) & 3 AS aerosol FROM fx_pixels"))
def mask_bits(spark, d):
    f = F.col("fmask")
    return a.pixels(spark, d).select("scene_id", "row", "col", (f.bitwiseAND(F.lit(2)) != 0).alias("cloud"), (f.bitwiseAND(F.lit(32)) != 0).alias("water"), F.call_function("shiftrightunsigned", f, F.lit(6)).bitwiseAND(F.lit(3)).alias("aerosol"))


@query("bit_02", sql("SELECT x.image_id, CAST(bit_count(xor(x.phash, y.phash)) AS INT) AS apart FROM fx_phash x JOIN fx_phash y ON y.image_id = x.image_id + 1"))
def popcounts(spark, d):
    x = a.phash(spark, d)
    y = x.select((F.col("image_id") - 1).alias("image_id"), F.col("phash").alias("_p"))
    return x.join(y, "image_id").select("image_id", s.hamming(F.col("phash"), F.col("_p")).alias("apart"))


@query("bit_03", sql("SELECT image_id, CAST(CASE WHEN phash < 0 THEN CAST(phash AS HUGEINT) + 18446744073709551616 ELSE phash END AS VARCHAR) AS unsigned FROM fx_phash"))
def unsigned_text(spark, d):
    p = F.col("phash")
    return a.phash(spark, d).select("image_id", F.when(p < 0, p.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(p.cast("decimal(20,0)")).cast("decimal(20,0)").cast("string").alias("unsigned"))


def bundle_text():
    """Canonical text of the decision-bearing inputs: families by name, prose left out."""
    def family(f):
        return s.canonical_json(agreement=s.json_number(F.round(F.col(f"{f}_agreement") * 100).cast("long")), available=s.json_number(F.col(f"{f}_available")), cluster_scale=s.json_number(F.col(f"{f}_cluster")), family=F.lit(f'"{f}"'))

    families = F.concat(F.lit("["), F.concat_ws(",", *(family(f) for f in sorted(v.FAMILIES))), F.lit("]"))
    return s.canonical_json(claim_id=s.json_number(F.col("claim_id")), families=families, intervention_type=s.json_text(F.col("type")), scene_scale=s.json_text(F.col("scene_scale")))


_family = lambda f: f"""'{{"agreement":' || CAST(CAST(round({f}_agreement * 100) AS BIGINT) AS VARCHAR) || ',"available":' || CAST({f}_available AS VARCHAR) || ',"cluster_scale":' || CAST({f}_cluster AS VARCHAR) || ',"family":"{f}"}}'"""
BUNDLE_SQL = """'{"claim_id":' || claim_id || ',"families":[' || """ + " || ',' || ".join(_family(f) for f in sorted(v.FAMILIES)) + """ || '],"intervention_type":"' || type || '","scene_scale":"' || scene_scale || '"}'"""


@query("hsh_01", sql(f"SELECT claim_id, version, {BUNDLE_SQL} AS canonical FROM fx_inputs"))
def canonical(spark, d):
    return a.verdict_inputs(spark, d).select("claim_id", "version", bundle_text().alias("canonical"))


@query("hsh_02", sql(f"SELECT claim_id, version, sha256({BUNDLE_SQL}) AS digest FROM fx_inputs"))
def digests(spark, d):
    return a.verdict_inputs(spark, d).select("claim_id", "version", F.sha2(bundle_text(), 256).alias("digest"))


def fingerprint() -> str:
    """The weights of the engine, in sorted order, as one line."""
    return "|".join(f"{k}={w:.6f}" for k, w in sorted(v.WEIGHTS.items()))


@query("hsh_03", sql(f"SELECT claim_id, sha256('{fingerprint()}|' || claim_id || '|' || version) AS digest FROM fx_newest_inputs"))
def config_fingerprint(spark, d):
    """The configuration's fingerprint bound to what was judged under it: one digest for each claim's newest bundle."""
    rows = a.verdict_inputs(spark, d, only_newest=True)
    return rows.select("claim_id", F.sha2(F.concat_ws("|", F.lit(fingerprint()), F.col("claim_id").cast("string"), F.col("version").cast("string")), 256).alias("digest"))


@query("hsh_04", sql("SELECT image_id, phash FROM fx_phash"))
def perceptual_hashes(spark, d):
    return a.phash(spark, d).select("image_id", "phash")


@query("arr_01", "SELECT vec_id, len(embedding) AS n FROM embeddings")
def lengths(spark, d):
    return a.read(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"))


@query("arr_02", "SELECT vec_id, len([x FOR x IN embedding IF x > 2]) > 0 AS any_large, len([x FOR x IN embedding IF x <= 5]) = len(embedding) AS all_small FROM embeddings")
def quantifiers(spark, d):
    return a.read(spark, d, "embeddings").select("vec_id", F.exists("embedding", lambda x: x > 2).alias("any_large"), F.forall("embedding", lambda x: x <= 5).alias("all_small"))


@query("arr_03", "SELECT vec_id, len([i FOR i IN generate_series(1, 32) IF embedding[i] > embedding[i + 32]]) AS n_greater FROM embeddings")
def zipped(spark, d):
    halves = F.zip_with(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), lambda x, y: x > y)
    return a.read(spark, d, "embeddings").select("vec_id", F.size(F.filter(halves, lambda x: x)).cast("long").alias("n_greater"))


@query("arr_04", sql("SELECT claim_id, version, list_position(['L0_recorded', 'L1_observed', 'L2_corroborated', 'L3_multi_indicator', 'L4_control_differenced'], level) AS rung FROM fx_levelled WHERE reached IS NOT NULL"))
def rungs(spark, d):
    rows = a.verdicts(spark, d).where(F.col("branch").isin("l4", "l3", "l2", "l1"))
    return rows.select("claim_id", "version", F.array_position(F.array(*map(F.lit, v.POSITIVE)), F.col("level")).cast("int").alias("rung"))


@query("arr_05", sql("SELECT claim_id, family, agreement, available FROM fx_evidence"))
def exploded(spark, d):
    return a.evidence(spark, d).select("claim_id", "family", "agreement", "available")


@query("arr_06", sql(f"SELECT claim_id, string_agg(family || ':' || CASE WHEN available THEN '1' ELSE '0' END, ',' ORDER BY list_position({list(v.DISPLAY_ORDER)!r}, family)) AS tree FROM fx_evidence GROUP BY 1"))
def collected(spark, d):
    """Families of a claim in display order, six at most."""
    order = F.array_position(F.array(*map(F.lit, v.DISPLAY_ORDER)), F.col("family"))
    entry = F.struct(order.alias("o"), F.concat("family", F.lit(":"), F.when(F.col("available"), "1").otherwise("0")).alias("t"))
    rows = a.evidence(spark, d).groupBy("claim_id").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    return rows.select("claim_id", F.array_join(F.transform("_e", lambda e: e["t"]), ",").alias("tree"))


@query("map_01", sql("SELECT intervention_id, coalesce(map {'check_dam': 1, 'farm_pond': 2, 'other': 3}[type], 0) AS code FROM fx_interventions"))
def lookups(spark, d):
    """Lookup with a default in a merged map; the later map's values win."""
    merged = {"check_dam": 9, "farm_pond": 2} | {"check_dam": 1, "other": 3}
    table = F.create_map(*(F.lit(x) for kv in merged.items() for x in kv))
    return a.interventions(spark, d).select("intervention_id", F.coalesce(F.try_element_at(table, F.col("type")), F.lit(0)).alias("code"))


@query("jsn_01", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, d):
    return a.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("jsn_02", "SELECT event_id, coalesce(json_extract_string(props, '$.per_season'), json_extract_string(props, '$.pairings'), json_extract_string(props, '$.k')) AS found FROM events")
def json_fallbacks(spark, d):
    at = lambda path: F.nullif(F.get_json_object("props", path), F.lit(""))
    return a.read(spark, d, "events").select("event_id", F.coalesce(at("$.per_season"), at("$.pairings"), at("$.k")).alias("found"))


@query("jsn_03", "SELECT l_orderkey AS claim_id, count(DISTINCT s) AS n_scenes FROM (SELECT l_orderkey, unnest(['S' || l_suppkey % 9, 'S' || l_partkey % 9]) AS s FROM lineitem) GROUP BY 1")
def harvested(spark, d):
    """Scene ids harvested from nested JSON of known shape."""
    scene = lambda c: F.concat(F.lit("S"), F.col(c) % 9)
    text = F.to_json(F.struct(F.struct(F.array(scene("l_suppkey")).alias("scene_ids")).alias("satellite"), F.struct(F.array(scene("l_partkey")).alias("scene_ids")).alias("temporal")))
    parsed = F.from_json(text, "satellite struct<scene_ids:array<string>>, temporal struct<scene_ids:array<string>>")
    rows = a.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), parsed.alias("_p"))
    rows = rows.select("claim_id", F.explode(F.concat("_p.satellite.scene_ids", "_p.temporal.scene_ids")).alias("_s"))
    return rows.groupBy("claim_id").agg(F.count_distinct("_s").alias("n_scenes"))


@query("jsn_04", sql("SELECT id, coalesce(payload, '{}') AS payload FROM fx_audit"))
def json_default(spark, d):
    return a.audit(spark, d).select("id", F.coalesce("payload", F.lit("{}")).alias("payload"))


@query("jsn_05", sql("SELECT claim_id, coalesce(detectability, 'recorded') AS gate FROM fx_claims"))
def gate_merge(spark, d):
    """Two gate records merged; the canonical one wins where it has a value."""
    older = F.create_map(F.lit("gate"), F.lit("recorded"))
    canonical = F.when(F.col("detectability").isNotNull(), F.create_map(F.lit("gate"), F.col("detectability"))).otherwise(F.create_map().cast("map<string,string>"))
    kept = F.map_filter(older, lambda k, _: ~F.array_contains(F.map_keys(canonical), k))
    return a.claims(spark, d).select("claim_id", F.element_at(F.map_concat(kept, canonical), "gate").alias("gate"))
