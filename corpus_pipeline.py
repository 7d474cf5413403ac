"""Corpus preparation: quality filter, exact and near deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's
docs. All but the last return the columns of ``docs``; a row stays or goes as a whole. Rows are told apart by doc_id
and text, so ids may repeat or be null: of rows that agree in both, the deduplicating stages keep one. Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravow.llm import decontaminate, exact_dedup, packing, quality, simhash_dedup
from terravow.llm.shared import table, written


def _only(docs: DataFrame, keep: DataFrame, key: Column) -> DataFrame:
    """One row of ``docs`` for each row of ``keep``: (_keep, _key), an id and what tells apart the rows that repeat it.

    Rows that agree in both are one document. Only where there are such rows does a window choose one of them. The rows
    of ``docs`` travel as one column, so their names meet none of these.
    """
    keep = written(keep.groupBy("_keep", "_key").agg(F.count(F.lit(1)).alias("_many")), "keep")
    of = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), docs["doc_id"].alias("_id"), docs["text"].alias("_text"), key.alias("_own"))
    found = of.join(keep, F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_own") == F.col("_key")))
    if not keep.where("_many > 1").isEmpty():
        first = F.row_number().over(Window.partitionBy("_id", "_own").orderBy("_text"))
        found = found.withColumn("_nth", first).where("_nth = 1")
    return found.select("_row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, with the smallest doc_id; a null id comes after all others."""
    marked = written(exact_dedup.exact_dedup(docs), "exact")
    chosen = marked.where("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_key"))
    # all rows of a chosen id and text are counted, so that repeated ones are seen
    all_rows = marked.select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_key"))
    same = (F.col("a._keep").eqNullSafe(F.col("b._keep"))) & (F.col("a._key") == F.col("b._key"))
    keep = all_rows.alias("a").join(chosen.alias("b"), same, "left_semi")
    return _only(docs, keep, F.lower(F.sha2(exact_dedup.normalised(docs["text"]), 256)))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the smallest doc_id, and of rows that repeat it the smallest fingerprint and text key."""
    marked = written(simhash_dedup.simhash_components(docs), "near")
    least = marked.where("doc_id <=> component_id").groupBy("root").agg(F.min(F.struct("fingerprint", "text_key")).alias("_first"))
    rows = marked.where("doc_id <=> component_id").join(least, "root").where("text_key = _first.text_key")
    return _only(docs, rows.select(F.col("doc_id").alias("_keep"), F.col("text_key").alias("_key")), simhash_dedup.text_key(docs["text"].cast("string")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed."""
    import public_tokenizers

    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learned scores, fingerprint components and packing have no SQL. Tests hold the exact, near and decontamination stages
#: against brute force, the quality stage against its operator's scores, and packing against the tokens of what is left.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
