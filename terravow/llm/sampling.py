"""Bounded samples of labelled rows to fit a model on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_part


def labelled_ids(labels: DataFrame, label: str, folds: int, held_out: int, id_col: str = "doc_id") -> DataFrame:
    """All (id, label) rows of the classes 0 and 1.

    Rows of the held-out fold, without id or with another or no label are left out; an id labelled twice has its larger label.
    """
    fit = labels.where((crc_part(F.col(id_col), folds) != held_out) & F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    return fit.groupBy(id_col).agg(F.max(F.col(label).cast("int")).alias("_label"))


def labelled_sample(labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``per_class`` rows of ``labelled_ids`` of each of the classes 0 and 1, in the order of a hash of the id."""
    fit = labelled_ids(labels, label, folds, held_out, id_col)
    order = [F.xxhash64(F.lit(label), F.col(id_col)), F.col(id_col)]
    return fit.where("_label = 1").orderBy(*order).limit(per_class).union(fit.where("_label = 0").orderBy(*order).limit(per_class))


def class_shares(labels: DataFrame, label: str, folds: int, held_out: int, id_col: str = "doc_id") -> tuple[int, int]:
    """How many rows outside the held-out fold carry label 0 and 1: the sample's class balance is mended by these."""
    found = dict(labels.where((crc_part(F.col(id_col), folds) != held_out) & F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int")).count().collect())
    return found.get(0, 0), found.get(1, 0)


def with_texts(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_label, text) of the sampled ids. The sample is bounded by its parameter, so it is the broadcast side."""
    sample = sample.withColumnRenamed(id_col, "_sampled")
    return docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text")).join(F.broadcast(sample), F.col("_id") == F.col("_sampled")).select("_id", "_label", "_text")
