"""Scalar expressions: seasons, indices, bits, canonical text, geometry. All are native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def season(day: Column | str) -> Column:
    month = F.month(_c(day))
    return F.when(month.between(6, 10), "kharif").when(month.between(3, 5), "summer").when(month.isNotNull(), "rabi")


def season_year(day: Column | str) -> Column:
    """November and December belong to the agricultural year that follows."""
    return F.year(_c(day)) + F.when(F.month(_c(day)) >= 11, 1).otherwise(0)


def season_midpoint(season_: Column | str, year: Column | str) -> Column:
    s, y = _c(season_), _c(year)
    return F.when(s == "kharif", F.make_date(y, F.lit(8), F.lit(15))).when(s == "rabi", F.make_date(y, F.lit(1), F.lit(1))).otherwise(F.make_date(y, F.lit(4), F.lit(15)))


def windows(day: Column | str, buffer: int = 3, length: int = 24) -> dict[str, Column]:
    """The spans before and after a claimed date; months are clamped step by step."""
    day = _c(day)
    pre_end, post_start = F.add_months(day, -buffer), F.add_months(day, buffer)
    return {"pre_start": F.add_months(pre_end, -length), "pre_end": pre_end, "post_start": post_start, "post_end": F.add_months(post_start, length)}


def window_side(at: Column | str, day: Column | str) -> Column:
    """pre, post, or null: the construction band is closed on both ends and asked first."""
    w, at = windows(day), _c(at)
    return F.when(at.between(w["pre_end"], w["post_start"]), F.lit(None)).when((at >= w["pre_start"]) & (at < w["pre_end"]), "pre").when((at > w["post_start"]) & (at <= w["post_end"]), "post")


def normalised_difference(a: Column, b: Column) -> Column:
    return F.when(F.abs(a + b) >= 1e-6, (a - b) / (a + b))


def reflectance(raw: Column | str) -> Column:
    return F.when(_c(raw) != -9999, _c(raw) * F.lit(1e-4))


def savi(nir: Column, red: Column, soil: float = 0.5) -> Column:
    if not 0 <= soil <= 1:
        raise ValueError("the soil factor lies in [0, 1]")
    total = nir + red + soil
    return F.when(F.abs(total) >= 1e-6, (nir - red) / total * (1 + soil))


def bsi(blue: Column, red: Column, nir: Column, swir1: Column) -> Column:
    return normalised_difference(swir1 + red, nir + blue)


def median_bits(vector: Column | str) -> Column:
    """A 64-bit number whose bit i is set where element i exceeds the median of the vector.

    The sorted vector is bound once, as the only element of an array, and not sorted again for every bit.
    """
    vector = _c(vector)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))

    def number(ordered: Column) -> Column:
        median = (F.get(ordered, F.lit(31)).cast("double") + F.get(ordered, F.lit(32)).cast("double")) / 2
        bits = F.transform(vector, lambda x, i: F.when(x.cast("double") > median, bit(i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda total, b: total.bitwiseOR(b))

    return F.get(F.transform(F.array(F.array_sort(vector)), number), F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def canonical_json(**fields: Column) -> Column:
    """JSON text with sorted keys, no blanks, nulls kept; for numbers, booleans and strings free of control characters."""
    parts = []
    for i, (name, value) in enumerate(sorted(fields.items())):
        parts += [F.lit(("," if i else "") + f'"{name}":'), value]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def json_text(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.coalesce(quoted, F.lit("null"))


def json_number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def lockout_seconds(failed: Column, free: int = 5, base: int = 30) -> Column:
    over = F.least(failed - free, F.lit(12))
    return F.when(failed < free, F.lit(0).cast("long")).otherwise(F.least(F.call_function("shiftleft", F.lit(base).cast("long"), F.greatest(over, F.lit(0)).cast("int")), F.lit(3600).cast("long")))


def stored(x: Column, places: int = 4) -> Column:
    """A double as it is stored: rounded half up at ``places``."""
    scale = 10.0**places
    return F.floor(x * scale + 0.5) / F.lit(scale)
