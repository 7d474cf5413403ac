"""Quality scores by Bradley-Terry pairwise ranking.

Every text is described by dense features of the whole text. From all preference pairs, a document labelled 1 preferred
to one labelled 0, weights are learned by the logistic loss on feature differences, so that P(a preferred to b) is
sigmoid(w.a - w.b). Every labelled document outside the held-out fold takes part, and so does every pair: what a pair adds
depends on the difference of two scores, so the sums over pairs are made of sums over the documents of each score,
scores being rounded to a grid for that. Documents are summed by Spark in whole numbers, so that their order does not
matter; the driver holds the grid alone. The accepting threshold is the exact quantile of all fitted documents' scores
at the share of label 0 among them; a document's score is the logistic of its distance from that threshold, placed so
that the threshold itself scores ``CUT``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_ids
from .shared import batches_of, crc_part, table, text_bytes, written

FOLDS, HELD_OUT, CUT = 4, 2, 0.7
#: Half the points of the grid of scores, the whole numbers of a unit in sums, and bins of a round when a rank is sought.
GRID, UNIT, BINS = 4096, 1 << 24, 4096
BLOCK_WORDS = 64
_UPPER, _LOWER, _DIGIT = (np.array([chr(i).isascii() and f(chr(i)) for i in range(256)]) for f in (str.isupper, str.islower, str.isdigit))
_MARKS = np.array([chr(i) in "#$%&*@^~<>{}[]\\=+_" for i in range(256)])
_STOPS = np.array([chr(i) in ".,;:?" for i in range(256)])
FEATURES = 18


def features(text: bytes) -> np.ndarray:
    """Dense features of a whole text; an empty one has zeros."""
    out = np.zeros(FEATURES)
    words = text.split()
    n = len(words)
    if not n:
        return out
    hist = np.zeros(256, "int64")
    for at in range(0, len(text), 1 << 22):
        hist += np.bincount(np.frombuffer(text, "u1", min(1 << 22, len(text) - at), at), minlength=256)
    size = len(text)
    letters = hist[_UPPER].sum() + hist[_LOWER].sum() + hist[128:].sum() + 1
    lengths = np.fromiter(map(len, words), "int64", n)
    counts = Counter(words)
    lines = text.split(b"\n")
    line_counts = Counter(lines)
    blocks = [len(set(words[a : a + BLOCK_WORDS])) / min(BLOCK_WORDS, n - a) for a in range(0, n - n % BLOCK_WORDS or n, BLOCK_WORDS)]
    blocks = np.array(blocks)
    caps = hist[_UPPER].sum() / letters
    out[:] = (
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        caps,
        min(caps, 0.2) * 5,
        hist[33] / n,
        hist[124] / n,
        hist[_MARKS].sum() / n,
        hist[_STOPS].sum() / n,
        hist[_DIGIT].sum() / size,
        hist[10] / n,
        1 - len(line_counts) / len(lines),
        sum(len(x) * (c - 1) for x, c in line_counts.items()) / size,
        (blocks < 0.4).mean(),
        1 - blocks.min(),
    )
    return out


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) * self.weights).sum(axis=1)  # row by row: the same however rows are batched

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x) - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw + np.log(CUT / (1 - CUT)), -40, 40)))


def _blocks(batches):
    """The label and features of each batch of measured rows."""
    for batch in batches:
        yield batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, FEATURES)


def _rows(keys: list[np.ndarray], values: np.ndarray) -> pa.RecordBatch:
    kept = pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype="int32"), values.ravel())
    return pa.RecordBatch.from_arrays([*(pa.array(k.astype("int32")) for k in keys), kept], names=[*("_label", "_bin")[: len(keys)], "_v"])


def _summed(rows: DataFrame, work, keys: list[str], width: int, kind: str) -> list:
    """The sums of the arrays that ``work`` makes of each task's rows, for each of ``keys``."""
    parts = rows.mapInArrow(work, ", ".join([*(f"{k} int" for k in keys), f"_v array<{kind}>"]))
    return parts.groupBy(*keys).agg(F.array(*(F.sum(F.col("_v")[i]) for i in range(width))).alias("_v")).collect()


def _scales(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of each class, mean and deviation of the features with both classes at equal weight, to six digits."""

    def work(batches):
        total = np.zeros((2, 3, FEATURES))
        for y, x in _blocks(batches):
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.stack([np.full(FEATURES, len(own)), own.sum(axis=0), (own * own).sum(axis=0)])
        yield _rows([np.repeat([0, 1], 3), np.tile([0, 1, 2], 2)], total.reshape(6, FEATURES))

    found = np.zeros((2, 3, FEATURES))
    for label, power, values in _summed(rows, work, ["_label", "_bin"], FEATURES, "double"):
        found[label, power] = values
    n = found[:, 0, 0]
    share = found[n > 0, 1:] / n[n > 0, None, None]
    mean, square = share.mean(axis=0) if len(share) else np.zeros((2, FEATURES))
    digits = np.vectorize(lambda v: float(f"{v:.6g}"))
    return n, digits(mean), digits(np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-6)


def _binned(rows: DataFrame, now: Ranking, step: float) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each class: the grid points that have documents, how many, and the sums of their scaled features."""

    def work(batches):
        for y, x in _blocks(batches):
            at = np.rint(now.raw(x) / step).astype("int64")
            key = at * 2 + y
            order = np.argsort(key, kind="stable")
            key, first = np.unique(key[order], return_index=True)
            if len(key):
                whole = np.column_stack([np.ones(len(x), "int64"), np.rint(now.scaled(x) * UNIT).astype("int64")])
                yield _rows([key & 1, key >> 1], np.add.reduceat(whole[order], first, axis=0))

    found = sorted(_summed(rows, work, ["_label", "_bin"], 1 + FEATURES, "long"), key=lambda r: r[:2])
    of = [[r for r in found if r[0] == c] for c in (0, 1)]
    return [np.array([r[1] for r in o]) * step for o in of], [np.array([r[2][0] for r in o], "f8") for o in of], [np.array([r[2][1:] for r in o], "f8") / UNIT for o in of]


def _spread(rows: DataFrame, now: Ranking, step: float, points: list[np.ndarray], mass: list[np.ndarray]) -> np.ndarray:
    """The sum of each document's scaled features times themselves, weighted by its grid point's mass."""

    def work(batches):
        total = np.zeros((FEATURES, FEATURES), "int64")
        for y, x in _blocks(batches):
            z, at, weight = now.scaled(x), np.rint(now.raw(x) / step), np.zeros(len(x))
            for c in (0, 1):
                weight[y == c] = mass[c][np.searchsorted(np.rint(points[c] / step), at[y == c])]
            for i in range(FEATURES):
                total[i] += np.rint(z * (z[:, i] * weight)[:, None] * UNIT).astype("int64").sum(axis=0)
        yield _rows([np.zeros(FEATURES), np.arange(FEATURES)], total)

    return np.array([r[2] for r in sorted(_summed(rows, work, ["_label", "_bin"], FEATURES, "long"))], "f8") / UNIT


def _over_pairs(points: list[np.ndarray], of) -> Iterator[tuple[slice, np.ndarray]]:
    """``of`` of the differences between points of label 1 and of label 0, a block of the former at a time."""
    for at in range(0, len(points[1]), 256):
        block = slice(at, at + 256)
        yield block, of(np.clip(points[1][block, None] - points[0][None, :], -40, 40))


def ranked(values: DataFrame, rank: int) -> float:
    """The value with the rank, from 0, in the only column: bins are counted until one value or few are left."""
    low, high = values.agg(F.min("_s"), F.max("_s")).first()
    while low < high:
        share = (F.col("_s") - low) / (high - low)
        inside = values.where(F.col("_s").between(low, high)).groupBy(F.least(F.lit(BINS - 1), F.floor(share * BINS)).alias("_bin"))
        for _, n, least, most in sorted(inside.agg(F.count(F.lit(1)), F.min("_s"), F.max("_s")).collect()):  # at most BINS rows
            if rank < n:
                low, high = least, most
                break
            rank -= n
    return low


def fit_ranking(rows: DataFrame, l2: float = 1e-3, rounds: int = 12) -> Ranking:
    """Newton's method on the logistic loss of all pairs. With one class alone no pair exists and all documents score alike."""
    n, mean, scale = _scales(rows)
    now = Ranking(mean, scale, np.zeros(FEATURES), 0.0)
    if not n.all():
        return Ranking(mean, scale, now.weights, -40.0 if n[1] or not n[0] else 40.0)
    for _ in range(rounds):
        step = max(1.0, 8 * np.abs(now.weights).sum()) / GRID
        points, counts, sums = _binned(rows, now, step)
        gradient, cross = -l2 * now.weights, np.zeros((FEATURES, FEATURES))
        mass = [np.zeros(len(p)) for p in points]
        for block, wrong in _over_pairs(points, lambda d: 1 / (1 + np.exp(d))):  # chance of a pair the wrong way round
            gradient = gradient + ((wrong @ counts[0]) @ sums[1][block] - (counts[1][block] @ wrong) @ sums[0]) / n.prod()
            bend = wrong * (1 - wrong)
            mass[1][block] = bend @ counts[0] / n.prod()
            mass[0] += counts[1][block] @ bend / n.prod()
            cross += sums[1][block].T @ (bend @ sums[0]) / n.prod()
        # masses are of the order of one over the rows: whole numbers are taken of them times the rows
        hessian = _spread(rows, now, step, points, [m * n.sum() for m in mass]) / n.sum() - cross - cross.T + l2 * np.eye(FEATURES)
        move = np.linalg.solve(hessian, gradient)
        now = Ranking(mean, scale, now.weights + move, 0.0)
        if np.abs(move).max() < 1e-3:
            break

    def scored(batches):
        for _, x in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(now.raw(x))], names=["_s"])

    raw, zeros = written(rows.mapInArrow(scored, "_s double"), "ranks"), int(n[0])
    return Ranking(mean, scale, now.weights, (ranked(raw, zeros - 1) + ranked(raw, zeros)) / 2)


def measured(batches):
    for batch in batches_of(batches):
        rows = np.array([features(t) for t in text_bytes(batch.column(1))]).reshape(-1, FEATURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), FEATURES).cast(pa.list_(pa.float64()))], names=["_id", "_x"])


def learn(docs: DataFrame, labels: DataFrame) -> Ranking:
    kind = docs.schema["doc_id"].dataType.simpleString()
    fit = docs.where(crc_part(F.col("doc_id"), FOLDS) != HELD_OUT).select("doc_id", F.col("text").cast("string"))
    rows = fit.mapInArrow(measured, f"_id {kind}, _x array<double>").join(labelled_ids(labels, "quality", FOLDS, HELD_OUT), F.col("_id") == F.col("doc_id"))
    return fit_ranking(written(rows.select("_label", "_x"), "features"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null or empty text has zero features and is scored like any other. Labels of the held-out fold are never read.
    Repeated rows are scored each; without labels of both classes all documents score alike.
    """
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))  # a few hundred bytes

    def scored(batches):
        for batch in batches_of(batches):
            rows = np.array([features(t) for t in text_bytes(batch.column(1))]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.scores(rows))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(scored, f"doc_id {kind}, score double")
    return out.select("doc_id", (crc_part(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``CUT``; the rows are filtered where they are read."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    at = docs.columns.index("text")

    def kept(batches):
        for batch in batches_of(batches):
            rows = np.array([features(t) for t in text_bytes(batch.column(at))]).reshape(-1, FEATURES)
            yield batch.filter(pa.array(held.value.scores(rows) >= CUT))

    return docs.mapInArrow(kept, docs.schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
