"""Ranked lexical search: each benchmark item's best documents, as a product of two dense matrices.

One pass over the documents keeps what the items' terms need: tiles of at most ``TILE_DOCS`` documents with the counts of
item terms, and what the tile adds to the corpus statistics. These are summed over all tiles. Then a tile of items
(occurrences of terms) is multiplied with a tile of documents (impact of terms) over the terms that both hold, in float64
through BLAS. Impacts are integers: columns are taken in groups whose sums stay below 2**53, so every product is exact,
and groups are added in 64-bit integers. A task keeps the best of each item over all its tiles, ties by document id, so
what is shuffled is ten rows an item and task.

The items' terms are broadcast; a benchmark beyond ``BLOCK_BYTES`` of text is searched in blocks of about that size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import words_of
from .shared import batches_of, table, text_bytes, written
from .topk import Best

BLOCK_BYTES = 32_000_000
TILE_DOCS = 256
TILE_ITEMS = 512
EXACT = 2**53


def _tiles(vocabulary: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) to tiles: ids, lengths and counts of item terms, documents, words, and documents by term."""

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            ids, texts = batch.column(0), text_bytes(batch.column(1))
            for at in range(0, len(texts), TILE_DOCS):
                taken, sizes, starts, terms, counts = [], [], [0], [], []
                documents = words = 0
                for k, text in enumerate(texts[at : at + TILE_DOCS], at):
                    own = words_of(text)
                    if not own:
                        continue
                    documents, words = documents + 1, words + len(own)
                    before = len(terms)
                    for word, n in Counter(own).items():
                        term = vocabulary.get(word)
                        if term is not None:
                            terms.append(term)
                            counts.append(n)
                    if len(terms) > before:
                        taken.append(k)
                        sizes.append(len(own))
                        starts.append(len(terms))
                held, holding = np.unique(np.array(terms, "i8"), return_counts=True)
                columns = [
                    pa.array([ids.take(pa.array(taken, pa.int64())).to_pylist()], pa.list_(batch.schema.field(0).type)),
                    *(pa.array([np.array(x, "<i8").tobytes()], pa.binary()) for x in (sizes, starts, terms, counts)),
                    pa.array([documents], pa.int64()),
                    pa.array([words], pa.int64()),
                    pa.array([held], pa.list_(pa.int64())),
                    pa.array([holding], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "sizes", "starts", "terms", "counts", "documents", "words", "held", "holding"])

    return tiled


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], "i8")


def impacts(tf: np.ndarray, size: np.ndarray, weight: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What one occurrence in an item of a term adds to the score, for each (term, document)."""
    if len(size) and 75 * int(size.max()) * documents >= 2**63:
        m = np.array([25 + 75 * int(n) * documents // words for n in size], "i8")
    else:
        m = 25 + 75 * size * documents // max(words, 1)
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def exact_product(items: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """items @ docs.T in 64-bit integers by float64 products over groups of columns whose sums stay below 2**53."""
    if not items.size or not docs.size:
        return np.zeros((len(items), len(docs)), "i8")
    most = items.max(axis=0) * docs.max(axis=0)
    total = np.zeros((len(items), len(docs)), "i8")
    at, ends = 0, np.cumsum(most)
    while at < len(most):
        before = ends[at - 1] if at else 0.0
        # the sums themselves are rounded: half of the bound leaves room for that
        to = int(np.searchsorted(ends, before + EXACT // 2, side="right"))
        if to <= at:  # one column that is too large by itself
            total += items[:, at].astype("i8")[:, None] * docs[:, at].astype("i8")[None, :]
            to = at + 1
        else:
            total += (items[:, at:to] @ docs[:, at:to].T).astype("i8")
        at = to
    return total


def _scored(names: list, held: list[dict[int, int]], weight: np.ndarray, documents: int, words: int, k: int):
    """Tiles to the best documents of each item in this task: (item, item_id, doc, score)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kinds = Best(np.ones(len(names)), k), None  # a score below 1 is no hit
        blocks = []
        for first in range(0, len(names), TILE_ITEMS):
            part = held[first : first + TILE_ITEMS]
            terms = np.array(sorted({t for x in part for t in x}), "i8")
            matrix = np.zeros((len(part), len(terms)))
            for row, x in enumerate(part):
                matrix[row, np.searchsorted(terms, list(x))] = list(x.values())
            blocks.append((first, terms, matrix))
        for batch in batches:
            kinds = batch.schema.field(0).type.value_type
            for ids, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes, starts, terms, counts = (np.frombuffer(x, "<i8") for x in packed)
                if not len(sizes):
                    continue
                owner = np.repeat(np.arange(len(sizes)), np.diff(starts))
                impact = impacts(counts, sizes[owner], weight[terms], documents, words)
                for first, own, matrix in blocks:
                    place = np.minimum(np.searchsorted(own, terms), len(own) - 1) if len(own) else terms
                    there = own[place] == terms if len(own) else np.zeros(len(terms), bool)
                    columns, dense = np.unique(place[there], return_inverse=True)
                    if not len(columns):
                        continue
                    docs = np.zeros((len(sizes), len(columns)))
                    docs[owner[there], dense] = impact[there]
                    best.add(np.arange(first, first + len(matrix)), exact_product(matrix[:, columns], docs), ids)
        rows = [(at, names[at], x[2], -x[0]) for at, found in enumerate(best.found) for x in found]
        if rows:
            item, name, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(name), pa.array(doc, kinds), pa.array(score, pa.int64())], ["item", "name", "doc", "score"])

    return scored


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0.

    Null texts hold no term. Items without a term that some document holds have no row. Items or documents that repeat
    an id are ranked as rows of their own; of equal scores the smaller id is first, a null id last. Without documents
    or items the result is empty. Columns beside ids and texts are neither read nor returned.
    """
    spark = docs.sparkSession
    doc_kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, doc_col), (items, item_col)))
    texts = items[text_col].cast("string")
    asked = written(items.select(items[item_col].alias("name"), texts.alias("text"), F.coalesce(F.octet_length(texts), F.lit(0)).alias("size")), "items")
    asked_bytes = asked.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, math.ceil(asked_bytes / block_bytes))
    found = [_block(spark, docs, asked, (at, blocks), k, doc_col, text_col, doc_kind, item_kind) for at in range(blocks)]
    rows = reduce(DataFrame.unionByName, [f.withColumn("block", F.lit(at)) for at, f in enumerate(found) if f is not None] or [spark.createDataFrame([], f"item long, name {item_kind}, doc {doc_kind}, score long, block int")])
    order = Window.partitionBy("block", "item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return rows.select(F.col("name").alias(item_col), "rank", F.col("doc").alias(doc_col), "score")


def _block(spark, docs: DataFrame, asked: DataFrame, block: tuple[int, int], k: int, doc_col: str, text_col: str, doc_kind: str, item_kind: str) -> DataFrame | None:
    """The best documents of one block of items by task, or None where it has no terms. A block is about BLOCK_BYTES of text."""
    at, blocks = block
    names, held, vocabulary = [], [], {}
    for name, text in asked.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == at).select("name", "text").collect():
        own = Counter(vocabulary.setdefault(w, len(vocabulary)) for w in words_of((text or "").encode("utf-8", "surrogatepass")))
        if own:
            names.append(name)
            held.append(dict(own))
    if not vocabulary:
        return None
    terms = spark.sparkContext.broadcast(vocabulary)
    schema = f"ids array<{doc_kind}>, sizes binary, starts binary, terms binary, counts binary, documents long, words long, held array<long>, holding array<long>"
    tiles = written(docs.select(docs[doc_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(lambda x: _tiles(terms.value)(x), schema), "tiles")
    documents, words = tiles.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    # one row a term of this block's items, whose number the block bounds
    df = np.zeros(len(vocabulary), "i8")
    for term, n in tiles.select(F.explode(F.arrays_zip("held", "holding")).alias("x")).groupBy("x.held").agg(F.sum("x.holding")).collect():
        df[term] = n
    known = spark.sparkContext.broadcast((names, held, weights(df, documents)))
    scored = lambda x: _scored(*known.value, documents, words, k)(x)
    return tiles.select("ids", "sizes", "starts", "terms", "counts").mapInArrow(scored, f"item long, name {item_kind}, doc {doc_kind}, score long")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark
), bt AS (
  SELECT i, term, count(*) AS c FROM (SELECT i, unnest(w) AS term FROM b) GROUP BY ALL
), sums AS (
  SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0
), dt AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM bt) GROUP BY ALL
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM dt, sums GROUP BY term
), impact AS (
  SELECT r, term, weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.w) * docs) // words))) AS x
  FROM dt JOIN d USING (r) JOIN weight USING (term), sums
), score AS (
  SELECT i, r, CAST(sum(c * x) AS BIGINT) AS score FROM bt JOIN impact USING (term) GROUP BY i, r HAVING sum(c * x) > 0
), place AS (
  SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM score JOIN d USING (r)
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM place JOIN b USING (i) WHERE rank <= 10
"""
