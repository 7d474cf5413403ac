"""Toxicity scores by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words, and word beginnings of 4 to 8 bytes, that are several times as frequent in the fitted
documents labelled toxic as in the others, each with the logarithm of that ratio as its weight. Spark counts them over
texts that are not near copies of each other (one per minimum shingle hash). Features are densities of lexicon words and beginnings over the whole text and within its densest stretch,
nearness of a second-person word, capitals, punctuation, and rates of obfuscated spellings. Trees are grown in numpy on
histograms; a part of the fitted rows is kept from them and gives the isotonic calibration.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import class_shares, labelled_sample, with_texts
from .shared import batches_of, crc_part, table, text_bytes, written

FOLDS, HELD_OUT, CUT = 3, 1, 0.7
#: Labelled rows of each class that the model is fitted on; size of the lexicon of words and of beginnings.
PER_CLASS, LEXICON = 2500, 400
STRETCH, NEAR, STRONG, REPEATS = 16, 5, 2.5, 4
LENGTHS = (4, 5, 6, 7, 8)
FEATURES = 18
_PLAIN = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))
_SPOKEN = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() or chr(i) in "@$*!" else 32 for i in range(256))
_UNMASK = bytes.maketrans(b"013457@$!", b"oieastasi")
_MASKED = re.compile(rb"[a-z][0-9@$*!]+[a-z]")
YOU = frozenset("you your yours yourself u ur vous votre vos tu te toi ton ta tes du dich dir dein deine ihr euch euer sie usted ustedes ti tus tuyo vosotros".encode().split())


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def beginnings(word: bytes) -> list[bytes]:
    return [word[:k] for k in LENGTHS if len(word) > k]


def firsts(starts: dict[bytes, float]) -> frozenset[bytes]:
    """The first bytes of all beginnings: they decide quickly whether any beginning can be a word's own."""
    return frozenset(s[:4] for s in starts)


def features(text: bytes, lexicon: dict[bytes, float], starts: dict[bytes, float], first: frozenset[bytes]) -> np.ndarray:
    """Dense features of a whole text; an empty one has zeros. ``first``: :func:`firsts` of ``starts``."""
    out = np.zeros(FEATURES)
    words = words_of(text)
    n = len(words)
    if not n:
        return out
    at_word = {i: lexicon[w] for i, w in enumerate(words) if w in lexicon}
    at_start = {}
    for i, w in enumerate(words):
        if w[:4] in first and (found := [starts[b] for b in beginnings(w) if b in starts]):
            at_start[i] = max(found)
    either = np.array(sorted({*at_word, *at_start}), "int64")
    weight = np.array([max(at_word.get(i, 0.0), at_start.get(i, 0.0)) for i in either.tolist()])
    strong = either[weight >= STRONG]
    you = np.array([i for i, w in enumerate(words) if w in YOU], "int64")
    near = 0
    if len(strong) and len(you):
        after = np.searchsorted(you, strong)
        gap = np.minimum(np.abs(you[np.minimum(after, len(you) - 1)] - strong), np.abs(strong - you[np.maximum(after - 1, 0)]))
        near = int((gap <= NEAR).sum())
    densest = 0.0
    if len(either):
        total = np.concatenate(([0.0], np.cumsum(weight)))
        densest = float((total[np.searchsorted(either, either + STRETCH)] - total[:-1]).max())
    masked = _MASKED.findall(text.lower()) if re.search(rb"[a-zA-Z][0-9@$*!]+[a-zA-Z]", text) else []
    unmasked = sum(w.translate(_UNMASK) in lexicon for w in text.translate(_SPOKEN).split() if not w.isalpha()) if masked else 0
    out[:] = (
        sum(at_word.values()) / n,
        sum(at_start.values()) / n,
        np.log1p(sum(at_word.values())),
        np.log1p(sum(at_start.values())),
        len(strong) / n,
        np.log1p(len(strong)),
        densest / min(n, STRETCH),
        np.log1p(len({words[i] for i in strong.tolist()})),
        weight.max() if len(weight) else 0,
        weight.sum() / np.sqrt(n),
        near / n,
        len(you) / n,
        sum(map(text.count, _UPPER_LETTERS)) / len(text),
        text.count(b"!") / n,
        text.count(b"?") / n,
        (text.count(b".") + text.count(b",")) / n,
        (len(masked) + unmasked) / n,
        np.log1p(n),
    )
    return out


_UPPER_LETTERS = [bytes([c]) for c in range(65, 91)]


@dataclass(frozen=True)
class Trees:
    """Boosted trees of equal depth as arrays: in node i a row goes to 2i+1 where its feature is at most the cut, else 2i+2."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), "int64")
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss on feature histograms."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    share = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    margin, inner = np.full(len(x), base), 2**depth - 1
    features_, cuts_, leaves_ = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, cut, node = np.zeros(inner, "int64"), np.full(inner, np.inf), np.zeros(len(x), "int64")
        for at in range(inner):
            here = np.flatnonzero(node == at)
            best = 1e-6
            if len(here) >= 10:
                total_g, total_h = g[here].sum(), h[here].sum()
                for f in range(x.shape[1]):
                    width = len(cuts[f]) + 1
                    left_g = np.cumsum(np.bincount(binned[here, f], g[here], width))[:-1]
                    left_h = np.cumsum(np.bincount(binned[here, f], h[here], width))[:-1]
                    if not len(left_g):
                        continue
                    gain = left_g**2 / (left_h + l2) + (total_g - left_g) ** 2 / (total_h - left_h + l2) - total_g**2 / (total_h + l2)
                    gain[(left_h < 0.5) | (total_h - left_h < 0.5)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[at], cut[at] = gain[k], f, cuts[f][k]
            node[here] = 2 * at + 1 + (x[here, feature[at]] > cut[at])
        leaf_of = node - inner
        leaf = rate * np.bincount(leaf_of, g, 2**depth) / (np.bincount(leaf_of, h, 2**depth) + l2)
        margin += leaf[leaf_of]
        features_.append(feature)
        cuts_.append(cut)
        leaves_.append(leaf)
    return Trees(base, np.array(features_), np.array(cuts_), np.array(leaves_))


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators; (knots, values) for linear interpolation."""
    blocks: list[list[float]] = []  # weight, sum of weighted labels, sum of weighted margins
    for k in np.argsort(margin, kind="stable"):
        blocks.append([weight[k], weight[k] * y[k], weight[k] * margin[k]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    w, s, m = np.array(blocks).T
    return m / w, s / w


@dataclass(frozen=True)
class Model:
    lexicon: dict[bytes, float]
    starts: dict[bytes, float]
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.values[0])
        first = firsts(self.starts)
        x = np.array([features(t, self.lexicon, self.starts, first) for t in texts]).reshape(-1, FEATURES)
        return np.clip(np.interp(self.trees.margin(x), self.knots, self.values), 0, 1)


def learn_lexicon(sample: DataFrame, size: int = LEXICON) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """Words and beginnings that mark label 1, with weights; ``sample``: _label, _text.

    A text counts each of them at most ``REPEATS`` times, and all the texts of one mark (near copies) count once.
    """

    def tokens(batches):
        for batch in batches_of(batches):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for label, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                words = words_of(text)
                mark = min((zlib.crc32(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0)
                found = Counter(b"w" + w for w in words)
                found.update(b"s" + s for w in words for s in beginnings(w))
                found[b"n"] = len(words)
                out[0].extend([label] * len(found))
                out[1].extend([mark] * len(found))
                out[2].extend(found)
                out[3].extend(min(c, REPEATS) if t != b"n" else c for t, c in found.items())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64())], names=["_label", "_mark", "_token", "_times"])

    found = sample.select("_label", "_text").mapInArrow(tokens, "_label int, _mark long, _token binary, _times long")
    found = found.groupBy("_token", "_label", "_mark").agg(F.max("_times").alias("_times")).groupBy("_token").agg(
        F.sum("_label").alias("texts"),
        F.sum(F.col("_times") * F.col("_label")).alias("one"),
        F.sum(F.col("_times") * (1 - F.col("_label"))).alias("zero"),
    )
    found = written(found.where("texts >= 4 OR _token = cast('n' AS binary)"), "lexicon")
    words = found.where("_token = cast('n' AS binary)").first()
    if words is None or not words["one"] or not words["zero"]:
        return {}, {}
    odds = F.log(F.col("one") / (F.col("zero") + 1)) - float(np.log(words["one"] / (words["zero"] + 1)))
    kinds = []
    for kind in (b"w", b"s"):
        rows = found.where((F.substring("_token", 1, 1) == F.lit(kind)) & (odds >= 1.2)).select("_token", odds.alias("weight"), "one")
        rows = rows.orderBy((F.col("one") * F.col("weight")).desc(), "_token").limit(size).collect()
        kinds.append({bytes(r[0])[1:]: float(r[1]) for r in rows})
    return kinds[0], kinds[1]


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    sample = with_texts(docs, labelled_sample(labels, "toxic", FOLDS, HELD_OUT, per_class)).select("_id", "_label", "_text")
    zero, one = class_shares(labels, "toxic", FOLDS, HELD_OUT)
    if not zero or not one:
        return Model({}, {}, None, np.zeros(1), np.array([float(one > 0)]))
    # The lexicon comes from one part of the sample, the trees from this and a second, the calibration from the third.
    part = F.pmod(F.xxhash64("_id"), F.lit(10))
    lexicon, starts = learn_lexicon(sample.where(part < 5))
    first = firsts(starts)

    def described(batches):
        for batch in batches_of(batches):
            rows = np.array([features(t, lexicon, starts, first) for t in text_bytes(batch.column(2))]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), FEATURES).cast(pa.list_(pa.float64()))], names=["part", "label", "x"])

    rows = sample.select(part.cast("int"), "_label", "_text").mapInArrow(described, "part int, label int, x array<double>").collect()  # at most 2 * per_class rows
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    part_, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x = np.array([r[2] for r in rows]).reshape(-1, FEATURES)
    weight = np.where(y == 1, one / max(1, (y == 1).sum()), zero / max(1, (y == 0).sum()))
    weight /= weight.mean() if len(weight) else 1
    fit = part_ < 7
    if len(set(y[fit])) < 2 or len(set(y[~fit])) < 2:
        fit = np.ones(len(y), bool)
    trees = boost(x[fit], y[fit], weight[fit])
    calibrate = ~fit if (~fit).any() else fit
    return Model(lexicon, starts, trees, *isotonic(trees.margin(x[calibrate]), y[calibrate], weight[calibrate]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null or empty text has zero features and is scored like any other. Labels of the held-out fold are never read.
    Repeated rows are scored each; without labels of both classes all documents score alike.
    """
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, per_class))  # bounded by LEXICON and the number of trees

    def scored(batches):
        for batch in batches_of(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.scores(text_bytes(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(scored, f"doc_id {kind}, score double")
    return out.select("doc_id", (crc_part(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
