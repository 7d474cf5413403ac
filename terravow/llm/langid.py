"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a window of bytes in both directions; each direction has an input table of 256 rows (the embedding,
folded into the three gates), a recurrent matrix and biases, and every position's label is a softmax over both hidden
states. It is trained in numpy by backpropagation through time with Adam on windows of a bounded sample of documents.
For a prediction the whole text is cut into windows, every position of every window is labelled, and the label
probabilities are averaged over the document.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import batches_of, crc_part, table, text_bytes

FOLDS, HELD_OUT = 4, 2
#: Documents of each language, and languages, that the network is fitted on; windows taken from each; bytes of a window.
PER_LANG, LANGS, WINDOWS, LENGTH = 400, 200, 4, 64
HIDDEN, ROUNDS, BATCH, RATE = 8, 220, 192, 0.02
#: Windows that move through the network together.
LANES = 8192
UNKNOWN = "und"


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Direction:
    table: np.ndarray  # (256, 3H): update, reset, candidate
    gates: np.ndarray  # (H, 2H)
    inner: np.ndarray  # (H, H)

    def run(self, steps: np.ndarray, keep: bool = False):
        """Hidden states (T, N, H) for bytes (T, N); with ``keep`` also what the way back needs."""
        length, lanes = steps.shape
        size = self.inner.shape[0]
        h, out, kept = np.zeros((lanes, size), "f4"), np.empty((length, lanes, size), "f4"), []
        for t in range(length):
            x = self.table.take(steps[t], axis=0)
            zr = h @ self.gates
            zr += x[:, : 2 * size]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :size], zr[:, size:]
            held = r * h
            c = held @ self.inner
            c += x[:, 2 * size :]
            np.tanh(c, out=c)
            before = h
            h = c - before
            h *= z
            h += before
            out[t] = h
            if keep:
                kept.append((before, zr, c, held))
        return (out, kept) if keep else out

    def back(self, steps: np.ndarray, kept: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of table, gates and inner from those of the hidden states."""
        size = self.inner.shape[0]
        d_table, d_gates, d_inner = (np.zeros_like(x) for x in (self.table, self.gates, self.inner))
        carry = np.zeros_like(grad[0])
        for t in range(len(kept) - 1, -1, -1):
            before, zr, c, held = kept[t]
            z, r = zr[:, :size], zr[:, size:]
            dh = grad[t] + carry
            d_c = dh * z * (1 - c * c)
            d_held = d_c @ self.inner.T
            d_zr = np.concatenate((dh * (c - before) * z * (1 - z), d_held * before * r * (1 - r)), axis=1)
            carry = dh * (1 - z) + d_held * r + d_zr @ self.gates.T
            d_inner += held.T @ d_c
            d_gates += before.T @ d_zr
            np.add.at(d_table, steps[t], np.concatenate((d_zr, d_c), axis=1))
        return [d_table, d_gates, d_inner]


@dataclass
class Network:
    forward: Direction
    backward: Direction
    out: np.ndarray  # (2H, K)
    bias: np.ndarray  # (K,)

    def logits(self, steps: np.ndarray) -> np.ndarray:
        size = self.forward.inner.shape[0]
        there, back = self.forward.run(steps), self.backward.run(steps[::-1])[::-1]
        return there @ self.out[:size] + back @ self.out[size:] + self.bias

    def parameters(self) -> list[np.ndarray]:
        return [self.forward.table, self.forward.gates, self.forward.inner, self.backward.table, self.backward.gates, self.backward.inner, self.out, self.bias]


def train(windows: np.ndarray, labels: np.ndarray, classes: int, hidden: int = HIDDEN, rounds: int = ROUNDS, batch: int = BATCH, rate: float = RATE, seed: int = 5) -> Network:
    """``windows``: (n, T) bytes; ``labels``: (n,). Cross-entropy over all positions, Adam with a falling rate."""
    random = np.random.default_rng(seed)
    draw = lambda *shape: (random.normal(size=shape) * 0.3).astype("f4")
    make = lambda: Direction(draw(256, 3 * hidden), draw(hidden, 2 * hidden), draw(hidden, hidden))
    net = Network(make(), make(), draw(2 * hidden, classes), np.zeros(classes, "f4"))
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    members = [np.flatnonzero(labels == k) for k in range(classes)]
    for step in range(1, rounds + 1):
        rows = np.concatenate([m[random.integers(0, len(m), max(1, batch // classes))] for m in members if len(m)])
        steps, y = np.ascontiguousarray(windows[rows].T), labels[rows]
        there, kept_there = net.forward.run(steps, keep=True)
        turned = np.ascontiguousarray(steps[::-1])
        back, kept_back = net.backward.run(turned, keep=True)
        back = back[::-1]
        logits = there @ net.out[:hidden] + back @ net.out[hidden:] + net.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(len(y)), y] -= 1
        p /= p.shape[0] * p.shape[1]
        flat = p.reshape(-1, classes)
        d_out = np.concatenate((there.reshape(-1, hidden).T @ flat, back.reshape(-1, hidden).T @ flat))
        grads = [
            *net.forward.back(steps, kept_there, p @ net.out[:hidden].T),
            *net.backward.back(turned, kept_back, (p @ net.out[hidden:].T)[::-1]),
            d_out,
            flat.sum(axis=0),
        ]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * (1 - 0.9 * step / rounds) * min(1, 1 / (norm + 1e-9))
        for p_, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p_ -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def document_probabilities(net: Network, texts: list[bytes], length: int = LENGTH, lanes: int = LANES) -> np.ndarray:
    """(documents, classes): position probabilities averaged over each whole text; zeros for an empty one."""
    classes = len(net.bias)
    sizes = np.fromiter(map(len, texts), "int64", len(texts))
    counts = -(-sizes // length)
    owner = np.repeat(np.arange(len(texts)), counts)
    starts = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * length
    total = np.zeros((len(texts), classes))
    base = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(texts) + bytes(length), "u1")
    view = np.lib.stride_tricks.sliding_window_view(flat, length)
    fill = np.minimum(length, sizes[owner] - starts)
    whole = np.argsort(fill < length, kind="stable")  # full windows first: they need no mask
    n_whole = int((fill == length).sum())
    for low, high in ((0, n_whole), (n_whole, len(whole))):
        for at in range(low, high, lanes):
            rows = whole[at : min(high, at + lanes)]
            steps = np.ascontiguousarray(view[base[owner[rows]] + starts[rows]].T)
            if low == n_whole:  # what lies behind a text's end is blank, as in training, whatever text comes next
                steps[np.arange(length)[:, None] >= fill[rows]] = ord(" ")
            p = net.logits(steps)
            p -= p.max(axis=2, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(axis=2, keepdims=True)
            if low == n_whole:
                p *= (np.arange(length)[:, None] < fill[rows])[:, :, None]
            for k in range(classes):
                total[:, k] += np.bincount(owner[rows], p[:, :, k].sum(axis=0), len(texts))
    return total / np.maximum(1, sizes)[:, None]


def has_letter(text: bytes) -> bool:
    if any(text[at : at + 4096].translate(None, _NO_LETTER) for at in range(0, len(text), 4096)):
        return True
    return not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))


_NO_LETTER = bytes(i for i in range(256) if not (i < 128 and chr(i).isalpha()))


def learn(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[Network | None, list[str]]:
    """The network and its languages, from at most ``per_lang`` documents of each language outside the held-out fold.

    They are those of the smallest id hashes. Of more than ``LANGS`` languages the most frequent are learned, of equally
    frequent ones the first by name.
    """
    known = docs.where((crc_part(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy(F.col("lang").cast("string").alias("_lang")).count().orderBy(F.desc("count"), "_lang").limit(LANGS).collect()
    if not sizes:
        return None, []
    # ids are hashed; below its bound lie half as many again as are wanted of a language, so few rows are ranked
    share = [(r["_lang"], min(1.0, (1.5 * per_lang + 64) / r["count"])) for r in sizes]
    bounds = docs.sparkSession.createDataFrame([(k, min(int(x * 2**64) - 2**63, 2**63 - 1)) for k, x in share], "_lang string, _bound long")
    near = known.select(F.col("doc_id").alias("_sampled"), F.col("lang").cast("string").alias("_lang")).join(F.broadcast(bounds), "_lang").where(F.xxhash64("_sampled") <= F.col("_bound"))
    nth = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_sampled"), "_sampled"))
    sample = near.withColumn("_nth", nth).where(F.col("_nth") <= per_lang).select("_sampled", "_lang")
    joined = known.select("doc_id", F.col("text").cast("string").alias("_text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_sampled"))

    def windows(batches):
        for batch in batches_of(batches):
            labels, cuts = [], []
            for lang, ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                for k in range(WINDOWS if len(text) > LENGTH else min(1, len(text))):
                    at = zlib.crc32(f"{ident} {k}".encode()) % max(1, len(text) - LENGTH + 1)
                    labels.append(lang)
                    cuts.append(text[at : at + LENGTH].ljust(LENGTH, b" "))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(cuts, pa.binary())], names=["lang", "cut"])

    kind = "lang string, cut binary"
    rows = joined.select("_lang", "doc_id", "_text").mapInArrow(windows, kind).collect()  # at most per_lang * LANGS * WINDOWS windows
    rows.sort(key=lambda r: (r[0], r[1]))
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None, []
    cut = np.frombuffer(b"".join(bytes(r[1]) for r in rows), "u1").reshape(-1, LENGTH)
    return train(cut, np.searchsorted(langs, [r[0] for r in rows]), len(langs)), langs


def language_labels(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    A null text, or one without a letter, is ``und`` with score 0, as is every text where no language can be learned.
    Repeated rows are labelled each.
    """
    net, langs = learn(docs, per_lang)
    held = docs.sparkSession.sparkContext.broadcast((net, langs))  # a few ten kilobytes

    def labelled(batches):
        net, langs = held.value
        for batch in batches_of(batches, 4_000_000):
            texts = [t if has_letter(t) else b"" for t in text_bytes(batch.column(1))]
            if net is None:
                texts = [b""] * len(texts)
            p = document_probabilities(net, texts) if net is not None else np.zeros((len(texts), 1))
            best = p.argmax(axis=1)
            names = [langs[k] if t else UNKNOWN for k, t in zip(best.tolist(), texts, strict=True)]
            score = np.where([bool(t) for t in texts], p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(np.clip(score, 0, 1), pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(labelled, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", (crc_part(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def op4_langid(spark, sf_dir: str) -> DataFrame:
    return language_labels(table(spark, sf_dir, "documents"))
