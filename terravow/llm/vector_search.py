"""Exact top-k by integer inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it. Sorted by that key, the vectors of a pivot lie in
annuli; an annulus is a block of at most ``BLOCK`` vectors with its two radii and its largest norm. For a query q and a
vector x of an annulus, d(q, x) is at least the gap between d(q, pivot) and the radii, so that

    <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2 <= (|q|^2 + norm^2 - gap^2) / 2,

which needs no unit vectors. A query first searches the annuli of its own pivot at its own distance; its k-th best score
is then a floor. The bound turned round gives an interval of distances for each pivot, beyond which expanding stops, and
only annuli within it are read; within a task the floor rises with what is found. Equal bounds are searched, so ties hold.

Queries are taken in groups of about ``GROUP`` neighbours, each broadcast (megabytes, whatever the table) and held
against all annuli that its bounds leave, so vectors are shuffled once, when the index is sorted. Range partitioning by
pivot, distance and row splits an annulus of equal vectors like any other.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .shared import batches_of, shared_folder, shuffle_width, table, written
from .topk import Best, rounded_down

#: Pivots are chosen from at most SAMPLE vectors, those with the smallest hashes, each the farthest from those before it.
PIVOTS, SAMPLE = 64, 2048
BLOCK = 1024
GROUP = 32_768
SCALE = 256
EXACT = 2**53
LONG = 2**63
_SLACK = 1e-9


def quantised(column: pa.Array) -> list[np.ndarray | None]:
    """floor(256 x) of each vector, as doubles that hold integers; None for a vector that takes no part."""
    if pa.types.is_null(column.type):
        return [None] * len(column)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(SCALE * column.values.cast(pa.float64()).to_numpy(zero_copy_only=False))
    offsets, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    finite = np.concatenate([[0], np.cumsum(np.isfinite(values))])
    return [values[a:b] if ok and finite[b] - finite[a] == b - a else None for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)]


def packed(vector: np.ndarray) -> bytes:
    """32-bit integers where these hold the vector, else doubles behind a mark."""
    small = not len(vector) or np.abs(vector).max() < 2**31
    return vector.astype("<i4").tobytes() if small else b"\1" + vector.astype("<f8").tobytes()


def matrix(vectors: list[bytes]) -> np.ndarray:
    """One row a vector; shorter ones are filled with zeros, which add nothing to a product."""
    rows = [np.frombuffer(v, "<i4") if len(v) % 4 == 0 else np.frombuffer(v[1:], "<f8") for v in vectors]
    full = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, row in enumerate(rows):
        full[k, : len(row)] = row
    return full


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows, as doubles below 2**53, beyond that as Python's integers within 64 bits."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not width or not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if width * float(np.abs(a).max()) * float(np.abs(b).max()) < EXACT:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    return np.minimum(np.maximum(whole(a) @ whole(b).T, -LONG), LONG - 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between rows, from differences: no cancellation for neighbours far from the origin.

    Beyond the range of doubles they are infinite or not a number; a bound made of such lets everything through.
    """
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    with np.errstate(over="ignore", invalid="ignore"):
        return np.stack([np.sqrt(((a - row) ** 2).sum(axis=1)) for row in b], axis=1) if len(b) else np.zeros((len(a), 0))


def _squares(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (rows**2).sum(axis=1)


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """At most n different rows of the sample, each the farthest from those before it."""
    chosen = [0]
    far = distances(sample, sample[:1])[:, 0]
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _keyed(pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            found = quantised(batch.column(3))
            rows = [k for k, v in enumerate(found) if v is not None]
            if not rows:
                continue
            vectors = [packed(found[k]) for k in rows]
            full = matrix(vectors)
            far = distances(full, pivots)
            near = far.argmin(axis=1)
            kept = batch.take(pa.array(rows, pa.int64()))
            columns = [*kept.columns[:3], pa.array(vectors, pa.binary()), pa.array(near, pa.int32()), pa.array(far[np.arange(len(rows)), near]), pa.array(np.sqrt(_squares(full)))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "asked", "vector", "pivot", "far", "norm"])

    return keyed


def _annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pivot and distance to blocks of one pivot each."""
    held: list[tuple] = []
    kind = None

    def block() -> pa.RecordBatch:
        rows, ids, vectors, pivots, far, norms = zip(*held, strict=True)
        held.clear()
        columns = [
            pa.array(pivots[:1], pa.int32()),
            pa.array([min(far)]),
            pa.array([max(far)]),
            pa.array([max(norms)]),
            pa.array([list(rows)], pa.list_(pa.int64())),
            pa.array([list(ids)], pa.list_(kind)),
            pa.array([list(vectors)], pa.list_(pa.binary())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["pivot", "low", "high", "norm", "rows", "ids", "vectors"])

    for batch in batches:
        kind = batch.schema.field(1).type
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (len(held) >= BLOCK or held[-1][3] != row[3]):
                yield block()
            held.append(row)
    if held:
        yield block()


def _searched(own: list[int], names: list, vectors: list[bytes], floors: np.ndarray, pivots: np.ndarray, k: int):
    """Annuli to the k best of each query in this task: (query, id, score)."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = matrix(vectors)
        best, far = Best(floors, k), distances(queries, pivots)
        square, kind = _squares(queries), pa.int64()
        for batch in batches:
            kind = batch.schema.field(5).type.value_type
            for pivot, low, high, norm, rows, ids, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with np.errstate(over="ignore", invalid="ignore"):
                    gap = np.maximum(0, np.maximum(low - far[:, pivot], far[:, pivot] - high) - _SLACK * (1 + high + far[:, pivot]))
                    most = square + np.float64(norm) ** 2
                    left = np.flatnonzero(~((most - gap**2) / 2 + _SLACK * (1 + most) < best.least))
                if not len(left):
                    continue
                block, place = matrix(held), {row: j for j, row in enumerate(rows)}
                for at in range(0, len(left), BLOCK):
                    asked = left[at : at + BLOCK]
                    scores = products(queries[asked], block)
                    for i, q in enumerate(asked):
                        if own[q] in place:
                            scores[i, place[own[q]]] = -math.inf
                    best.add(asked, scores, ids)
        found = [(q, x[2], -x[0], names[q], own[q]) for q, hits in enumerate(best.found) for x in hits]
        if found:
            types = [pa.int64(), kind, pa.int64(), kind, pa.int64()]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["query", "id", "score", "asked_id", "asked_row"])

    return searched


def top_k(vectors: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", group: int = GROUP) -> DataFrame:
    """(query_id, rank, id, score): for each row where ``asked`` holds, the k other rows of highest integer inner product.

    Components are floor(256 x). A vector that is null or holds a null or a component that is not finite (256 times it
    included) takes no part. Shorter vectors count as filled with zeros; an empty one has the product 0 with all. Rows
    that repeat an id or a vector are rows of their own, and a query is never its own result. Equal scores go by the
    smaller id, a null id last. With fewer than k other rows all are returned; an empty table gives an empty result.
    A score beyond 64 bits counts as the nearest 64-bit number. Other columns are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    plain = vectors.select(vectors[id_col].alias("id"), F.coalesce(asked, F.lit(False)).alias("asked"), vectors[vector_col].alias("vector"))
    order = [F.xxhash64("vector"), F.col("id")]
    sample = plain.where("vector IS NOT NULL").where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))).orderBy(*order).limit(SAMPLE).select("vector").collect()
    seen = [v for v in quantised(pa.array([r["vector"] for r in sample], pa.list_(pa.float64()))) if v is not None] if sample else []
    pivots = pivots_of(matrix([packed(v) for v in seen]), PIVOTS) if seen else np.zeros((1, 0))
    keyed = plain.select(F.monotonically_increasing_id().alias("row"), "id", "asked", "vector").mapInArrow(_keyed(pivots), f"row long, id {kind}, asked boolean, vector binary, pivot int, far double, norm double")
    keyed = written(keyed, "keyed")
    key = ["pivot", "far", "row"]
    ordered = keyed.repartitionByRange(shuffle_width(spark), *key).sortWithinPartitions(*key).select("row", "id", "vector", "pivot", "far", "norm")
    index = written(ordered.mapInArrow(_annuli, f"pivot int, low double, high double, norm double, rows array<long>, ids array<{kind}>, vectors array<binary>"), "index")
    cells = {r["pivot"]: r for r in index.groupBy("pivot").agg(F.max("norm").alias("norm"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}  # at most PIVOTS rows
    questions = keyed.where("asked")
    groups = max(1, math.ceil(questions.count() / group))
    questions = written(questions.repartitionByRange(groups, *key).select("row", "id", "vector", F.spark_partition_id().alias("group")), "questions")
    folder = f"{shared_folder(spark)}/nearest-{uuid.uuid4().hex}"
    out = f"query long, id {kind}, score long, asked_id {kind}, asked_row long"
    spark.createDataFrame([], out).write.parquet(folder)
    for at in range(groups):
        _group(questions.where(F.col("group") == at), index, cells, pivots, k, out, folder)
    found = spark.read.schema(out).parquet(folder)
    rank = F.row_number().over(Window.partitionBy("asked_row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select(F.col("asked_id").alias("query_id"), "rank", F.col("id").alias(id_col), "score")


def _within(intervals: dict[int, tuple[float, float]]) -> Column:
    """The annuli that meet their pivot's interval of distances; the filter reaches the scan."""
    found = F.lit(False)
    for pivot, (low, high) in intervals.items():
        own = F.col("pivot") == pivot
        if np.isfinite(high - low):
            own &= (F.col("low") <= float(high)) & (F.col("high") >= float(low))
        found = found | own
    return found


def _group(questions: DataFrame, index: DataFrame, cells: dict[int, Row], pivots: np.ndarray, k: int, out: str, folder: str) -> None:
    """Write the k best by task of one group of queries."""
    asked = questions.select("row", "id", "vector").collect()
    if not asked:
        return
    own, names, vectors = map(list, zip(*asked, strict=True))
    queries = matrix(vectors)
    far, square = distances(queries, pivots), _squares(queries)
    known = questions.sparkSession.sparkContext.broadcast((own, names, vectors))

    def search(intervals: dict[int, tuple[float, float]], floors: np.ndarray) -> DataFrame:
        return index.where(_within(intervals)).mapInArrow(lambda x: _searched(*known.value, floors, pivots, k)(x), out)

    # first the annuli of each query's own pivot at its own distance, for a floor
    near = far.argmin(axis=1)
    home = {int(p): (far[near == p, p].min(), far[near == p, p].max()) for p in np.unique(near)}
    first = search(home, np.full(len(own), -math.inf))
    nth = first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc()))).where(F.col("rank") == k)
    floors = np.full(len(own), -math.inf)
    for query, score in nth.select("query", "score").collect():  # at most one row a query of the group
        floors[query] = rounded_down(score) if abs(score) < LONG - 1 else -math.inf
    # then, of every pivot, as far as the bound lets a query's floor be met
    wide = {}
    with np.errstate(over="ignore", invalid="ignore"):
        for pivot, cell in cells.items():
            room = (square + np.float64(cell["norm"]) ** 2) * (1 + _SLACK) + 1 - 2 * floors
            may = ~(room < 0)
            if may.any():
                reach, own = np.sqrt(room[may]) * (1 + _SLACK) + 1, far[may, pivot]
                low, high = (own - reach).min(), (own + reach).max()
                if not (low > cell["high"] or high < cell["low"]):
                    wide[pivot] = (low, high)
    search(wide, floors).write.mode("append").parquet(folder)


def op11_vector_search(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""
