"""Exact deduplication as a tree merge of sorted digest runs, in DataFrame functions only.

Every row belongs to one of 2**b runs by a hash of its id, so rows of one text are dealt over all runs however many
there are. A run is first reduced to one entry a digest (smallest id, row count). Then runs merge up a binomial tree:
in each round the runs whose indices agree but for the next ``radix_bits`` low bits are exchanged and merged, sorted by
digest, and only the smallest id is retained. Three binomial rounds are folded into one eight-way merge, so a shuffle
moves digests, never texts, and each round moves at most one entry a digest and run. Verification holds at every level:
entries merge only where SHA-256, a 64-bit hash by another function and the byte length all agree.
The way down gives every run its winners, so the last join is keyed by run and digest: a text that makes up a third of
all rows is still spread over all runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shuffle_width, table, written

SPACE = r"[\x20\x09-\x0D]+"
_KEY = ["_digest", "_check", "_size"]


def normalised(text: Column) -> Column:
    """The text that is compared: white space runs are one space, null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_bits: int | None = None, radix_bits: int = 3) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Among equal texts the smallest id stays; a null id comes after all others. Where rows
    repeat id and text, exactly one of them has ``kept``. An empty table gives an empty result. Other columns of ``df``
    are neither read nor returned.
    """
    spark = df.sparkSession
    if run_bits is None:
        run_bits = math.ceil(math.log2(4 * shuffle_width(spark)))
    rounds = max(1, math.ceil(run_bits / radix_bits))
    rows = df.select(df[id_col].alias("_id"), normalised(df[text_col]).alias("_norm"))
    rows = rows.select(
        "_id",
        F.shiftrightunsigned(F.xxhash64("_id"), 64 - rounds * radix_bits).cast("int").alias("_run"),
        F.unhex(F.sha2("_norm", 256)).alias("_digest"),
        F.xxhash64("_norm").alias("_check"),
        F.octet_length("_norm").alias("_size"),
    )
    rows = written(rows, "digests")
    leaves = rows.groupBy("_run", *_KEY).agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    level = leaves
    for step in range(1, rounds + 1):
        level = _merge(level.withColumn("_node", F.shiftright("_run", step * radix_bits)))
    winners = level.select(*_KEY, F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"))
    down = leaves.select("_run", *_KEY).join(winners, _KEY)
    same = Window.partitionBy("_run", *_KEY, "_id").orderBy("_id")
    out = rows.join(down, ["_run", *_KEY]).withColumn("_nth", F.row_number().over(same))
    return out.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def _merge(level: DataFrame) -> DataFrame:
    """One multiway merge: the sorted runs of a node become one, an entry a digest."""
    run = Window.partitionBy("_node", *_KEY).orderBy(F.col("_keep").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = level.withColumns({"_total": F.sum("_n").over(whole), "_nth": F.row_number().over(run)})
    return merged.where("_nth = 1").select("_run", *_KEY, "_keep", F.col("_total").alias("_n"))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept,
       text_sha256
FROM d
"""
