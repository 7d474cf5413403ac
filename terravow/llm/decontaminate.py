"""Benchmark decontamination: an FM-index per training shard, searched backwards for benchmark phrases.

A shard is a few megabytes of documents. Its words are numbered by the benchmark's vocabulary; a word outside it can be
in no phrase and becomes a separator, and stretches shorter than the shortest phrase are left out, so the index holds
what could match. The suffix array of the rest (prefix doubling in numpy) gives the Burrows-Wheeler transform, kept as
a wavelet matrix with rank counts. All phrases are searched backwards at once; every occurrence is located by walking
back to a sampled suffix position. Removal spans of a document are the merged occurrences.

The phrases are broadcast only up to ``PHRASE_BYTES`` of benchmark text; a larger benchmark is dealt out in blocks of
that size, each searched in turn, and the spans of all blocks are merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches_of, table, text_bytes, written

WINDOW = 10
SAMPLING = 8
PHRASE_BYTES = 4_000_000
SHARD_BYTES = 12_000_000
_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass
class Phrases:
    """Distinct windows of the items, as word numbers from 1; windows of one length form one matrix."""

    number: dict[bytes, int]
    windows: dict[int, np.ndarray]  # length -> (n, length)
    items: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> (offsets, item positions)
    names: list[str]

    @staticmethod
    def of(rows: list[tuple[str, bytes]], window: int) -> Phrases:
        number: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        names = sorted({name for name, _ in rows})
        place = {name: k for k, name in enumerate(names)}
        for name, text in rows:
            words = [number.setdefault(w, len(number) + 1) for w in words_of(text)]
            if words:
                size = min(window, len(words))
                for at in range(len(words) - size + 1):
                    found.setdefault(size, {}).setdefault(tuple(words[at : at + size]), set()).add(place[name])
        windows = {size: np.array(list(group), "i8") for size, group in found.items()}
        items = {
            size: (np.cumsum([0, *map(len, group.values())]), np.array([k for ks in group.values() for k in sorted(ks)], "i8"))
            for size, group in found.items()
        }
        return Phrases(number, windows, items, names)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, int, np.ndarray]] = []
        for bit in reversed(range(max(1, (sigma - 1).bit_length()))):
            bits = symbols >> bit & 1
            ranks = np.zeros(len(symbols) + 1, "i4")
            np.cumsum(bits, out=ranks[1:])
            self.levels.append((bit, len(symbols) - int(ranks[-1]), ranks))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """Occurrences of each symbol before each end."""
        at = [np.zeros(len(symbol), "i8"), *ends]
        for bit, zeros, ranks in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            for k, e in enumerate(at):
                ones = ranks.take(e)
                at[k] = np.where(one, zeros + ones, e - ones)
        return [e - at[0] for e in at[1:]]

    def access(self, place: np.ndarray) -> np.ndarray:
        symbol, at = np.zeros(len(place), "i8"), place
        for bit, zeros, ranks in self.levels:
            ones = ranks.take(at)
            one = ranks.take(at + 1) > ones
            symbol |= one.astype("i8") << bit
            at = np.where(one, zeros + ones, at - ones)
        return symbol


class FMIndex:
    """Index of a sequence of numbers in which 0 separates; each separator sorts as a symbol of its own."""

    def __init__(self, sequence: np.ndarray, sigma: int, sampling: int = SAMPLING):
        n = len(sequence)
        separators = np.flatnonzero(sequence == 0)
        rank = sequence + len(separators)
        rank[separators] = np.arange(len(separators))
        suffixes, step = np.argsort(rank, kind="stable"), 1
        while True:
            after = np.zeros(n, "i8")
            after[: n - step] = rank[step:] + 1
            key = rank * (n + len(separators) + sigma + 2) + after
            suffixes = np.argsort(key, kind="stable")
            ordered = key[suffixes]
            new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            rank = np.empty(n, "i8")
            rank[suffixes] = new
            step *= 2
            if new[-1] == n - 1 or step >= n:
                break
        previous = sequence[suffixes - 1]
        self.matrix = WaveletMatrix(previous, sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=sigma + 1))))
        # Every position divisible by the sampling is kept, and all behind a separator: no walk crosses one.
        self.kept = np.where((suffixes % sampling == 0) | (previous == 0), suffixes, -1)
        self.size = n

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffix array whose suffixes begin with each pattern."""
        low, high = np.zeros(len(patterns), "i8"), np.full(len(patterns), self.size, "i8")
        alive = np.arange(len(patterns))
        for column in reversed(range(patterns.shape[1])):
            symbol = patterns[alive, column]
            a, b = self.matrix.rank(symbol, low[alive], high[alive])
            low[alive], high[alive] = self.first[symbol] + a, self.first[symbol] + b
            dead = low[alive] >= high[alive]
            high[alive[dead]] = low[alive[dead]]
            alive = alive[~dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffix array rows."""
        place, walked, open_ = np.full(len(rows), -1, "i8"), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            kept = self.kept[rows[open_]]
            done = kept >= 0
            place[open_[done]] = kept[done] + walked
            open_ = open_[~done]
            symbol = self.matrix.access(rows[open_])
            rows[open_] = self.first[symbol] + self.matrix.rank(symbol, rows[open_])[0]
            walked += 1
        return place


def shard_hits(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each text: words, first and one-past-last words of the merged spans, positions of the items found."""
    number, coded, sizes = phrases.number, [], np.zeros(len(texts), "i8")
    for k, text in enumerate(texts):
        words = words_of(text)
        sizes[k] = len(words)
        coded.append(np.fromiter([number.get(w, 0) for w in words], "i8", len(words)))
    none = np.zeros(0, "i8")
    starts, stops, items = [none] * len(texts), [none] * len(texts), [none] * len(texts)
    if not phrases.windows:
        return sizes, starts, stops, items
    # one separator in front of each text, and one at the end
    flat = np.zeros(int(sizes.sum()) + len(texts) + 1, "i8")
    first = np.cumsum(sizes + 1) - sizes
    for k, codes in enumerate(coded):
        flat[first[k] : first[k] + len(codes)] = codes
    edge = np.diff((flat > 0).astype("i1"))
    begin, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    long = end - begin >= min(phrases.windows)
    begin, end = begin[long], end[long]
    if not len(begin):
        return sizes, starts, stops, items
    length = end - begin + 1  # with the separator behind
    place = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    index = FMIndex(flat[place], len(number) + 1)
    cover, texts_hit, items_hit = np.zeros(len(flat) + 1, "i4"), [], []
    for size, patterns in phrases.windows.items():
        low, high = index.search(patterns)
        hits = high - low
        which = np.repeat(np.arange(len(patterns)), hits)
        at = place[index.locate(np.repeat(low - (np.cumsum(hits) - hits), hits) + np.arange(int(hits.sum())))]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
        text = np.searchsorted(first, at, "right") - 1
        pairs = np.unique(text * len(patterns) + which)
        text, which = pairs // len(patterns), pairs % len(patterns)
        offsets, found = phrases.items[size]
        many = offsets[which + 1] - offsets[which]
        texts_hit.append(np.repeat(text, many))
        items_hit.append(found[np.repeat(offsets[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))])
    covered = np.concatenate(([0], (np.cumsum(cover) > 0).astype("i1"), [0]))
    edge = np.diff(covered)
    span, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(first, span, "right") - 1
    pairs = np.unique(np.concatenate(texts_hit) * max(1, len(phrases.names)) + np.concatenate(items_hit))
    hit_text, hit_item = pairs // max(1, len(phrases.names)), pairs % max(1, len(phrases.names))
    for k in np.unique(owner).tolist():
        a, b = np.searchsorted(owner, [k, k + 1])
        starts[k], stops[k] = span[a:b] - first[k], stop[a:b] - first[k]
        c, d = np.searchsorted(hit_text, [k, k + 1])
        items[k] = hit_item[c:d]
    return sizes, starts, stops, items


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, phrase_bytes: int = PHRASE_BYTES) -> Iterator[tuple[int, Phrases]]:
    """The benchmark's phrases, about ``phrase_bytes`` of text at a time, each time with the number of blocks."""
    texts = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text") + F.octet_length("name") + 16)).first()[0] or 0
    blocks = max(1, -(-int(total) // phrase_bytes))
    for block in range(blocks):
        part = texts.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block)
        yield blocks, Phrases.of([(r["name"], r["text"].encode()) for r in part.collect()], window)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that no phrase hits; the rows are filtered where they are read."""
    at = docs.columns.index(text_col)
    for _, phrases in phrase_blocks(benchmark, window):
        held = docs.sparkSession.sparkContext.broadcast(phrases)

        def kept(batches, held=held):
            for batch in batches_of(batches, SHARD_BYTES):
                starts = shard_hits(text_bytes(batch.column(at)), held.value)[1]
                yield batch.filter(pa.array([len(s) == 0 for s in starts], pa.bool_()))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, spans (array of start and stop word, merged), items (array of item ids as strings).

    A null or empty text has no words and no spans; a benchmark item without words has no window, and an item id given
    twice counts once. An empty benchmark hits nothing. Repeated ids and repeated rows are reported each; where the
    benchmark is searched in blocks, rows are numbered and written once, and told apart by their number.
    """
    found, rows = None, docs.select(docs[id_col], docs[text_col].cast("string").alias("_text"))
    for blocks, phrases in phrase_blocks(benchmark, window, phrase_bytes):
        if found is None:
            rows = rows.withColumn("_row", F.monotonically_increasing_id() if blocks > 1 else F.lit(0).cast("long"))
            rows = written(rows, "numbered") if blocks > 1 else rows
        hits = _searched(rows, phrases, id_col)
        found = hits if found is None else found.unionByName(hits)
    if blocks == 1:
        return found.drop("_row")
    merged = found.groupBy(id_col, "_row", "n_words").agg(F.flatten(F.collect_list("spans")).alias("_s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.aggregate(
        F.array_sort("_s"),
        F.array().cast("array<struct<start:bigint,stop:bigint>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], s["stop"]).alias("stop"))))).otherwise(F.concat(done, F.array(s))),
    )
    return merged.select(id_col, "n_words", joined.alias("spans"), "items")


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def _searched(rows: DataFrame, phrases: Phrases, id_col: str) -> DataFrame:
    """``rows``: id, text, number."""
    held = rows.sparkSession.sparkContext.broadcast(phrases)

    def searched(batches):
        for batch in batches_of(batches, SHARD_BYTES):
            texts = text_bytes(batch.column(1))
            sizes, starts, stops, items = shard_hits(texts, held.value)
            offsets = pa.array(np.cumsum([0, *map(len, starts)]), pa.int32())
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(starts)), pa.array(np.concatenate(stops))], fields=list(_SPAN))
            names = [[held.value.names[k] for k in i.tolist()] for i in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes), pa.ListArray.from_arrays(offsets, flat), pa.array(names, pa.list_(pa.string()))], names=[id_col, "_row", "n_words", "spans", "items"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(searched, f"`{id_col}` {kind}, _row long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS phrase
  FROM b, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS t(i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM d, (SELECT DISTINCT size FROM bw), unnest(generate_series(1, len(w) - size + 1)) AS t(i)
), hit AS (
  SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.phrase = bw.phrase
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(i, i + size - 1)) AS t(p) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
