"""Near duplicates by SimHash fingerprints, found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each padded to 23. The [23,12,7] Golay code is
perfect: every 23-bit word lies within distance 3 of exactly one codeword, and one at distance 3 has five more
codewords at distance 4. A segment's keys are the indices of all codewords within distance 4 (one or six). Two segments
that differ in at most 2 bits share a key, since the codeword nearest to a word halfway between them is within 3 + 1 of
both. Of 4 or fewer differing bits, at most one segment can hold 3 or more: so two of the three segments share a key
each, and a pair of segment keys (24 bits) is what candidates are joined on. Each candidate pair is verified by its
exact Hamming distance.

Fingerprints are reduced to distinct values first. A bucket of equal keys emits a spanning forest of its links, not all
pairs, so a large group of near copies costs edges in proportion to its size; buckets beyond ``BLOCK`` fingerprints are
split in blocks and every pair of blocks meets in a task of its own. Components then come from the edge table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import batches_of, table, text_bytes, written

SHINGLE, SEED, DISTANCE = 4, 42, 4
WIDTHS = (22, 21, 21)
#: Fingerprints of one bucket that a task compares; more are dealt out as pairs of blocks.
BLOCK = 30_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, of the binary Golay code


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED, step: int = 65_536) -> int:
    """SimHash of a whole text as a signed 64-bit number; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1 :]
    ones = np.zeros(64, "int64")
    for at in range(0, n, step):
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : min(n, at + step)].tolist(), ends[at : at + step].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype="int64")
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``_text_key`` (a hash of the text as it is) and ``_fp``; a null text has no words."""

    def hashed(batches):
        for batch in batches_of(batches):
            fps = pa.array([fingerprint(t) for t in text_bytes(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fps], names=[id_col, "_text_key", "_fp"])

    kind = df.schema[id_col].dataType.simpleString()
    text = df[text_col].cast("string")
    return df.select(df[id_col], text, text_key(text)).mapInArrow(hashed, f"`{id_col}` {kind}, _text_key long, _fp long")


def text_key(text: Column) -> Column:
    """Tells apart rows that repeat an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


class Golay:
    """Indices of the codewords within distance 4 of 23-bit words."""

    def __init__(self):
        self.low = self._remainder(np.arange(1 << 12, dtype="int64"))  # remainders are linear: two small tables make one large
        self.high = self._remainder(np.arange(1 << 11, dtype="int64") << 12)
        errors: list[list[int]] = [[] for _ in range(1 << 11)]
        for weight in range(5):
            for places in combinations(range(23), weight):
                pattern = sum(1 << p for p in places)
                errors[int(self.remainder(np.array([pattern]))[0])].append(pattern)
        self.errors = np.array([(e + [-1] * 6)[:6] for e in errors], "int64")
        assert max(map(len, errors)) == 6

    @staticmethod
    def _remainder(words: np.ndarray) -> np.ndarray:
        rest = words.copy()
        for bit in range(22, 10, -1):
            rest ^= np.where(rest >> bit & 1, _GENERATOR << (bit - 11), 0)
        return rest

    def remainder(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0xFFF] ^ self.high[words >> 12]

    def keys(self, words: np.ndarray) -> np.ndarray:
        """(n, 6) codeword indices of 12 bits, -1 where there are fewer."""
        errors = self.errors[self.remainder(words)]
        return np.where(errors < 0, -1, (words[:, None] ^ np.maximum(errors, 0)) >> 11)


_golay: list[Golay] = []


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in fps): for each two segments, every pair of their keys."""
    if not _golay:
        _golay.append(Golay())
    unsigned, segments, at = fps.view("u8"), [], 0
    for width in WIDTHS:
        segments.append(_golay[0].keys((unsigned >> np.uint64(at) & np.uint64((1 << width) - 1)).astype("int64")))
        at += width
    keys, rows = [], []
    for which, (a, b) in enumerate(combinations(segments, 2)):
        both = np.where((a[:, :, None] >= 0) & (b[:, None, :] >= 0), which << 24 | a[:, :, None] << 12 | b[:, None, :], -1).reshape(len(fps), 36)
        row, column = np.nonzero(both >= 0)
        keys.append(both[row, column])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _near(one: np.uint64, others: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(others ^ one) <= distance


def forest(fps: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[int, int]]:
    """Edges that connect exactly what links within ``distance`` connect among ``fps`` (unsigned, distinct)."""
    waiting = fps
    while len(waiting):
        queue, waiting = [waiting[0]], waiting[1:]
        while queue and len(waiting):
            one = queue.pop()
            near = _near(one, waiting, distance)
            if near.any():
                found = waiting[near]
                waiting = waiting[~near]
                queue.extend(found)
                yield from ((int(one), int(x)) for x in found)


class _Joined:
    """Union-find over the fingerprints linked so far in a task: an edge within a component is not emitted again."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y] if y in up else y
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links(keys: np.ndarray, fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Verified links within runs of equal keys; short runs all at once, long ones as forests."""
    change = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    length = np.diff(np.append(change, len(keys)))
    short = (length > 1) & (length <= 24)
    run, size = change[short], length[short]
    for shift in range(1, int(size.max()) if len(size) else 0):
        open_run, open_size = run[size > shift], size[size > shift]
        for lead in range(int(open_size.max()) - shift):
            a = open_run[open_size > lead + shift] + lead
            hit = np.bitwise_count(fps[a] ^ fps[a + shift]) <= distance
            yield from zip(fps[a[hit]].tolist(), fps[a[hit] + shift].tolist())
    for at, n in zip(change[length > 24].tolist(), length[length > 24].tolist()):
        yield from forest(fps[at : at + n], distance)


def edges_of(keyed: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) among the fingerprints of each bucket; ``keyed``: _key, _fp, equal keys together and sorted."""

    def linked(batches):
        seen, held = _Joined(), None
        def out(keys, fps):
            pairs = [p for p in _links(keys, fps, distance) if seen.join(*p)]
            arrays = np.array(pairs, "u8").reshape(-1, 2).view("i8")
            return pa.RecordBatch.from_arrays([pa.array(arrays[:, 0]), pa.array(arrays[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view("u8")
            if held:
                keys, fps = np.concatenate((held[0], keys)), np.concatenate((held[1], fps))
            last = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
            held = keys[last:], fps[last:]
            if last:
                yield out(keys[:last], fps[:last])
        if held:
            yield out(*held)

    return keyed.mapInArrow(linked, "a long, b long")


def simhash_components(df: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, fingerprint, component_id, and beside them root and text_key.

    ``root`` names the component by its smallest fingerprint, which tells apart components that share a smallest id
    where ids repeat; ``text_key`` is the :func:`text_key` of the row's text.

    Fingerprints within ``distance`` bits (at most 4) are linked, fingerprint zero like any other; component_id is the
    smallest id reachable. Rows with a null id take part; they only give a component its id where all its ids are null.
    Repeated rows give repeated results. An empty table gives an empty result.
    """
    if distance > 4:
        raise ValueError("the segment keys guarantee links of up to 4 differing bits")
    marked = written(fingerprints(df, id_col, text_col), "fingerprints")
    classes = written(marked.groupBy("_fp").agg(F.min(id_col).alias("_rep")), "classes")

    def keyed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fps = batch.column(0).slice(at, 20_000).to_numpy()
                keys, rows = bucket_keys(fps)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], names=["_key", "_fp"])

    keys = classes.select("_fp").mapInArrow(keyed, "_key long, _fp long")
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = keys.groupBy("_key").count().where(F.col("count") > BLOCK)
    large = [(r[0], -(-r[1] // BLOCK)) for r in large.collect()]  # at most one entry for BLOCK key rows
    if large:
        keys = _in_blocks(keys, large)
    edges = edges_of(keys.repartition(width, "_key").sortWithinPartitions("_key"), distance)
    linked = components(edges, "a", "b")
    rooted = classes.join(linked, classes["_fp"] == linked["node"], "left").select("_fp", "_rep", F.coalesce("root", "_fp").alias("_root"))
    rooted = written(rooted, "rooted")
    smallest = written(rooted.groupBy("_root").agg(F.min("_rep").alias("component_id")), "smallest")  # written, so that the join may be split at a giant component
    label = rooted.select("_fp", "_root").join(smallest, "_root").select("_fp", "_root", "component_id")
    hexed = F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint")
    return marked.join(label, "_fp").select(F.col(id_col), hexed, "component_id", F.col("_root").alias("root"), F.col("_text_key").alias("text_key"))


def _in_blocks(keys: DataFrame, large: list[tuple[int, int]]) -> DataFrame:
    """Rows of large buckets, copied to every pair of blocks that theirs is in, under a key of that pair."""
    sizes = keys.sparkSession.createDataFrame(large, "_key long, _blocks int")
    dealt = keys.join(sizes, "_key", "left")
    block = F.pmod(F.xxhash64("_fp"), F.col("_blocks")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.least(j, block) * F.col("_blocks") + F.greatest(j, block)))
    plain = dealt.where("_blocks IS NULL").select("_key", "_fp")
    return plain.unionByName(dealt.where("_blocks IS NOT NULL").select("_key", "_fp", pair.alias("_pair")).select((F.shiftleft(F.col("_pair").cast("long") + 1, 26) + F.col("_key")).alias("_key"), "_fp"))


def op9_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
