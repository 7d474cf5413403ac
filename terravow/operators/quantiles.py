"""Exact quantiles of groups of any size, by counting: no group's values meet in one task.

A wanted quantile is a rank in its group. Rounds of a histogram over the values that may still hold it, counted before
anything is shuffled, say in which of ``BINS`` bins the rank lies; the bin's own least and largest value are the next
bounds. Bins divide values evenly, and in every other round their logarithms, so outliers and wide scales do not hold
the search up. What decides is the counts, so the result is exact whatever the bins. When at most ``LIMIT`` values are
left, or all that are left are equal, the value with the rank is picked. Groups within the limit need no round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written

LIMIT = 200_000
BINS = 1024
#: The largest and least finite double: infinite values share the outermost bins with these.
_MOST = 1.7976931348623157e308


def _bin(x: Column, low: Column, high: Column, by_logarithm: bool) -> Column:
    """The bin of x between low and high; it never falls as x rises. The least value has a bin of its own, so that every
    round leaves less, however close the values are."""

    def scaled(c: Column) -> Column:
        c = F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), c)) / 2
        return F.signum(c) * F.when(c == 0, 0.0).otherwise(F.ln(F.abs(c)) + 746) if by_logarithm else c

    share = (scaled(x) - scaled(low)) / F.nullif(scaled(high) - scaled(low), F.lit(0.0))
    return F.when(x == low, 0).otherwise(1 + F.coalesce(F.least(F.lit(BINS - 1), F.floor(share * BINS)), F.lit(0))).cast("int")


def _within(values: DataFrame, intervals: DataFrame) -> DataFrame:
    """The values of each interval of their group. The intervals are the small side; Spark may broadcast it or split the other."""
    return values.join(intervals.select("_g", "_low", "_high").distinct(), "_g").where((F.col("_x") >= F.col("_low")) & (F.col("_x") <= F.col("_high")))


def _narrowed(values: DataFrame, sought: DataFrame, by_logarithm: bool) -> DataFrame:
    """One round: each rank with the bounds and the number of values of the bin that it lies in."""
    place = ["_g", "_low", "_high"]
    binned = _within(values, sought).withColumn("_bin", _bin(F.col("_x"), F.col("_low"), F.col("_high"), by_logarithm))
    counted = binned.groupBy(*place, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    before = F.sum("_n").over(Window.partitionBy(*place).orderBy("_bin")) - F.col("_n")  # over at most BINS + 1 rows
    found = sought.drop("_inside").join(counted.withColumn("_before", before), place)
    at = F.col("_rank") - F.col("_below")
    found = found.where((at >= F.col("_before")) & (at < F.col("_before") + F.col("_n")))
    return found.select("_g", "_rank", F.col("_least").alias("_low"), F.col("_most").alias("_high"), (F.col("_below") + F.col("_before")).alias("_below"), F.col("_n").alias("_inside"))


def _picked(values: DataFrame, sought: DataFrame) -> DataFrame:
    """(_g, _rank, _value) where few values are left or all are equal."""
    equal = sought.where("_low = _high").select("_g", "_rank", F.col("_low").alias("_value"))
    few = sought.where("_low < _high")
    place = ["_g", "_low", "_high"]
    numbered = _within(values, few).withColumn("_nth", F.row_number().over(Window.partitionBy(*place).orderBy("_x")) - 1)
    found = few.join(numbered, place).where(F.col("_nth") == F.col("_rank") - F.col("_below"))
    return equal.unionByName(found.select("_g", "_rank", F.col("_x").alias("_value")))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], limit: int = LIMIT) -> DataFrame:
    """The keys, ``n``, and a column for each of ``quantiles`` (name to share), interpolated between neighbours.

    Null values and those that are not a number are left out; a group without another has no row. Null keys are a group;
    without keys all rows are one. Other columns are not read, whatever their names.
    """
    group = F.struct(*(rows[k].alias(k) for k in keys)) if keys else F.struct(F.lit(0).alias("_all"))
    values = written(rows.select(group.alias("_g"), rows[value].cast("double").alias("_x")).where("_x IS NOT NULL AND NOT isnan(_x)"), "values")
    sizes = values.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    sizes = written(sizes, "sizes")
    at = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in quantiles.items()}
    ranks = F.array_distinct(F.array(*(f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil))))
    sought = sizes.select("_g", F.explode(ranks).alias("_rank"), "_low", "_high", F.lit(0).cast("long").alias("_below"), F.col("n").alias("_inside"))
    done, by_logarithm = [], False
    wide = (F.col("_inside") > limit) & (F.col("_low") < F.col("_high"))
    while True:
        done.append(sought.where(~wide))
        sought = sought.where(wide)
        if sought.isEmpty():
            break
        sought = written(_narrowed(values, sought, by_logarithm), "sought")
        by_logarithm = not by_logarithm
    picked = _picked(values, reduce(DataFrame.unionByName, done))
    found = picked.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_found"))  # two entries a quantile
    out = sizes.join(found, "_g")
    of = lambda x, f: F.col("_found")[f(x).cast("long")]
    between = {name: F.when(of(x, F.floor) == of(x, F.ceil), of(x, F.floor)).otherwise(of(x, F.floor) + (of(x, F.ceil) - of(x, F.floor)) * (x - F.floor(x))) for name, x in at.items()}
    return out.select(*(F.col("_g")[k].alias(k) for k in keys), "n", *(x.alias(name) for name, x in between.items()))
