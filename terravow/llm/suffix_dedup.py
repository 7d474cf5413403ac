"""Removal of repeated byte strings: anchors thin the positions, Spark ranks and groups what may repeat.

Every byte covered by a string of ``length`` bytes that also starts elsewhere is removed.

:func:`doubled_spans` is prefix doubling as such: every position, rank pairs at doubling offsets, sorted and reranked
until unique or past ``length``. It is exact without any fingerprint, and shuffles some forty bytes a position and
round, which the README gives in figures. :func:`repeated_spans`, which the query uses, finds the same spans on large
tables. Positions are thinned first, without loss: a window (a string of ``length`` bytes) is represented by its
anchor, the place in it whose eight bytes hash lowest among those with ``PREFIX`` bytes of the window still behind
them. Equal windows have their anchor at the same offset; the windows of one anchor are neighbours. Ranks are then
taken of growing strings, and what is unique leaves:

1. anchors by the ``PREFIX`` bytes behind them; those with a unique rank leave;
2. the rest by the whole stretch that their windows cover (its two halves' ranks as a pair). An equal stretch means
   that all the anchor's windows are repeated: the stretch is removed;
3. anchors still open are cut in blocks of ``BLOCK`` windows: a block leaves if what its windows have in common is
   unique, and is removed if the stretch it covers is repeated;
4. what is left are single windows, ranked by the pair of their halves.

A rank is a fingerprint of its string, 64 bits to a half. What is still open reaches the next scan as a :class:`Sieve`:
a bitmap sized by the exact count of what it holds, up to ``MAP_BITS``; beyond that nothing is broadcast and the same
rows are found by a join. A sieve can only let too much through; what is removed rests on exact counts of rank pairs.
Counts are partial aggregates, so a string found in a third of all documents reaches each reducer as one row a task.

:func:`shared_passages` marks the documents that share ``WORDS`` consecutive words with another one, however few bytes
they have. It removes nothing. Anchors among the words' starts and classes of stretches thin the positions as above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from .shared import batches_of, table, text_bytes, written

LENGTH, PREFIX, BLOCK = 400, 128, 8
#: A passage of over 50 words, and the words of it that lie behind its anchor.
WORDS, WORD_PREFIX = 51, 16
#: How many bytes of texts are hashed together.
TOGETHER = 1 << 16
#: log2 of the most bits that a map may have (64 MB), and the bits it has for each number it holds.
MAP_BITS, BITS_EACH = 29, 32
#: How far a number is shifted for each of its bits in a map.
PROBES = (0, 17, 34)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANKS = bytes.maketrans(b"\t\n\v\f\r", b" " * 5)


def _least(hashed: np.ndarray, starts: int, width: int) -> np.ndarray:
    """The least of the ``width`` numbers from each of the first ``starts`` places on."""
    reached, least = 1, hashed
    while reached * 2 <= width:
        least, reached = np.minimum(least[:-reached], least[reached:]), reached * 2
    return np.minimum(least[:starts], least[width - reached : width - reached + starts])


def _turns(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each anchor once, with the first and last start of its windows."""
    change = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    return anchor[change], change, np.append(change[1:], len(anchor)) - 1


def anchors(text: bytes, length: int = LENGTH, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text and the first and last start of their windows."""
    size, width = len(text), length - prefix + 1
    if size < length:
        none = np.zeros(0, "i8")
        return none, none, none
    parts, step = [], 1 << 22
    for at in range(0, size - length + 1, step):  # stretches of window starts: memory does not follow the text's length
        starts = min(step, size - length + 1 - at)
        places = starts + width - 1
        words = np.ndarray((places,), "<u8", memoryview(text[at : at + places + 7].ljust(places + 8, b"\0")), strides=(1,))
        hashed = (words * _MIX) & np.uint64(0xFFFFFFFF00000000)
        hashed |= np.arange(places, dtype="u8")
        parts.append((_least(hashed, starts, width) & np.uint64(0xFFFFFFFF)).astype("i8") + at)
    return _turns(np.concatenate(parts))


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _groups(sizes: list[int], least: int) -> Iterator[list[int]]:
    """Places of the texts of at least ``least``, in groups of about ``TOGETHER`` bytes."""
    group, total = [], 0
    for k, n in enumerate(sizes):
        if n < least:
            continue
        if group and total + n > TOGETHER:
            yield group
            group, total = [], 0
        group.append(k)
        total += n
    if group:
        yield group


def _found(hashed: np.ndarray, bounds: np.ndarray, length: int, width: int) -> list[Found]:
    """Anchors and first and last starts for each stretch of places between bounds; every stretch has a window."""
    low32 = np.uint64(0xFFFFFFFF)
    least = _least(hashed & ~low32 | np.arange(len(hashed), dtype="u8"), len(hashed) - length + 1, width)
    start = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
    at, first, last = _turns((least[start] & low32).astype("i8"))
    low, high, cut = start[first], start[last], np.searchsorted(at, bounds)
    return [(at[i:j] - a, low[i:j] - a, high[i:j] - a) for a, i, j in zip(bounds[:-1].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


_NONE: Found = (np.zeros(0, "i8"),) * 3


def anchors_of(texts: list[bytes], length: int = LENGTH, prefix: int = PREFIX) -> list[Found]:
    """:func:`anchors` of many texts; short ones are hashed together."""
    found = [_NONE] * len(texts)
    for group in _groups([len(t) for t in texts], length):
        if len(group) == 1:
            found[group[0]] = anchors(texts[group[0]], length, prefix)
            continue
        together = b"".join([texts[k] for k in group])
        bounds = np.cumsum([0, *(len(texts[k]) for k in group)])
        hashed = np.ndarray((len(together),), "<u8", together + bytes(8), strides=(1,)) * _MIX
        for k, one in zip(group, _found(hashed, bounds, length, length - prefix + 1), strict=True):
            found[k] = one
    return found


def _rank(part: bytes | memoryview) -> int:
    n = xxh3_64_intdigest(part)
    return n - (1 << 64) if n >> 63 else n


def _ranks(view: memoryview, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Ranks of the strings from each start to its stop."""
    return np.array([xxh3_64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], "u8").view("i8")


def _pair(part: memoryview, seed: int) -> tuple[int, int]:
    """Ranks of the two halves; ``seed`` tells apart what may be compared only within itself."""
    half = len(part) // 2
    a, b = xxh3_64_intdigest(part[:half], seed), xxh3_64_intdigest(part[half:], seed)
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def _doc_key(ident, text: bytes) -> bytes:
    """128 bits of a document's id and text. Documents of equal text may share a key: they lose the same bytes."""
    return hashlib.blake2b(text, digest_size=16, salt=str(ident).encode()[-16:]).digest()


def _number(key: bytes) -> int:
    """What Spark's xxhash64 makes of a key."""
    n = xxh64_intdigest(key, 42)
    return n - (1 << 64) if n >> 63 else n


def _mark(key: bytes | list[int], anchor: np.ndarray | list[int]) -> np.ndarray:
    """A number for (document, anchor), well mixed; ``key`` is a document's, or numbers of contexts."""
    of = np.frombuffer(key[:8], "u8") if isinstance(key, bytes) else np.asarray(key, "i8").view("u8")
    with np.errstate(over="ignore"):
        x = (np.asarray(anchor, "u8") + np.uint64(1)) * _MIX ^ of
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(29)).view("i8")


class Sieve:
    """Which well-mixed 64-bit numbers may be in a column: a bitmap with three bits set for each."""

    def __init__(self, held: np.ndarray, bits: int):
        self.held, self.bits = held, bits

    @staticmethod
    def of(df: DataFrame, column: str, most: int = MAP_BITS) -> Broadcast | None:
        """Broadcast, with ``BITS_EACH`` bits a row or at least eight; None where that takes more than 2**most bits.

        ``df`` is counted first, so it should be a written table. At most 2**(most - 15) rows of 4 KB come to the driver.
        """
        n = df.count()
        bits = max(16, min((n * BITS_EACH).bit_length(), most))
        if n * 8 > 1 << most:
            return None
        low = F.explode(F.array(*(F.shiftrightunsigned(F.col(column), k).bitwiseAND(F.lit((1 << bits) - 1)) for k in PROBES)))
        rows = df.select(low.alias("_p")).select(F.shiftright("_p", 15).alias("_k"), F.col("_p").bitwiseAND(F.lit(32767)).alias("_b")).groupBy("_k").agg(F.bitmap_construct_agg("_b").alias("_m")).collect()
        held = np.zeros(1 << bits - 3, "u1")
        for k, _m in rows:
            held[k * 4096 : (k + 1) * 4096] = np.frombuffer(bytes(_m), "u1")
        return df.sparkSession.sparkContext.broadcast(Sieve(held, bits))

    def lets_through(self, numbers: np.ndarray | list[int]) -> np.ndarray:
        through, of = np.ones(len(numbers), bool), np.asarray(numbers, "i8").view("u8")
        for k in PROBES:
            low = (of >> np.uint64(k) & np.uint64((1 << self.bits) - 1)).view("i8")
            through &= (self.held[low >> 3] >> (low & 7)) & 1 == 1
        return through


def _may(sieve: Broadcast | None, numbers: np.ndarray | list[int]) -> np.ndarray:
    """What the sieve lets through; everything where there is none."""
    return np.ones(len(numbers), bool) if sieve is None else sieve.value.lets_through(numbers)


def _scan(docs: DataFrame, found_in: Callable[[list, list[bytes]], list], per_text: Callable[..., Iterator[tuple]], shape: list[tuple[str, str, pa.DataType]], id_col: str, text_col: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows made from each text: ``per_text`` yields a list of values a column.

    It gets id, text and what ``found_in`` finds in the text; that is asked for many ids and texts at once, and texts
    for which it finds None are passed over.
    """

    def scanned(batches):
        for batch in batches_of(batches, 4_000_000):
            out: list[list] = [[] for _ in shape]
            idents, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            extra = [batch.column(k).to_pylist() for k in range(2, batch.num_columns)]
            for ident, text, found, *rest in zip(idents, texts, found_in(idents, texts), *extra, strict=True):
                if found is not None:
                    for row in per_text(ident, text, found, *rest):
                        for column, values in zip(out, row, strict=True):
                            column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, _, kind) in zip(out, shape, strict=True)], names=[n for n, _, _ in shape])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *more).mapInArrow(scanned, ", ".join(f"{n} {t}" for n, t, _ in shape))


def _of_owners(owners: Broadcast | None, find: Callable[[list[bytes]], list]) -> Callable[[list, list[bytes]], list]:
    """``find`` for the documents that the sieve of their keys lets through."""

    def found_in(idents, texts):
        go = np.flatnonzero(_may(owners, [_number(_doc_key(i, t)) for i, t in zip(idents, texts, strict=True)]) if owners is not None else np.ones(len(texts), bool)).tolist()
        found = [None] * len(texts)
        for k, one in zip(go, find([texts[k] for k in go]), strict=True):
            found[k] = one
        return found

    return found_in


def _open(may: Broadcast | None, found: list, ranked: Callable[..., np.ndarray]) -> list:
    """(what was found, ranks of its anchors, places of the anchors that may repeat); the sieve is asked once for all."""
    ranks = [None if one is None else ranked(k, one) for k, one in enumerate(found)]
    go = _may(may, np.concatenate([np.zeros(0, "i8"), *(r for r in ranks if r is not None)]))
    out, at = [], 0
    for one, rank in zip(found, ranks, strict=True):
        if rank is None:
            out.append(None)
            continue
        open_ = np.flatnonzero(go[at : at + len(rank)])
        at += len(rank)
        out.append((one, rank, open_) if len(open_) else None)
    return out


def _longs(*names: str) -> list[tuple[str, str, pa.DataType]]:
    return [(n, "long", pa.int64()) for n in names]


_DOC = [("_doc", "binary", pa.binary())]


def _repeated(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")


def _open_classes(rows: DataFrame, rank: str, *place: str) -> DataFrame:
    """``place`` of one member of each class of equal rank pairs, where a rank has several classes.

    Only there can one class share a window with another: the members of a rank's only class are removed if there are
    several, or unique.
    """
    classes = rows.groupBy(rank, "left", "right").agg(F.min(F.struct(*place)).alias("_first"))
    several = classes.groupBy(rank).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(rank)
    return classes.join(several, rank, "left_semi").select("_first.*")


def repeated_spans(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", map_bits: int = MAP_BITS) -> DataFrame:
    """(_doc, start, stop): byte spans to remove, overlapping ones included; ``_doc`` is a document's :func:`_doc_key`."""

    def prefixes(ident, text, found):
        yield (_ranks(memoryview(text), found[0], found[0] + prefix).tolist(),)

    def every(idents, texts):
        return anchors_of(texts, length, prefix)

    may_repeat = written(_repeated(_scan(docs, every, prefixes, _longs("rank"), id_col, text_col), "rank"), "ranks")
    may = Sieve.of(may_repeat, "rank", map_bits)

    def repeating(idents, texts):
        return _open(may, anchors_of(texts, length, prefix), lambda k, one: _ranks(memoryview(texts[k]), one[0], one[0] + prefix))

    def stretches(ident, text, found):
        (at, low, high), rank, go = found
        at, low, high, rank, view = at[go], low[go], high[go], rank[go], memoryview(text)
        pairs = [_pair(view[a : b + length], (c - a) << 20 | b - a) for a, b, c in zip(low.tolist(), high.tolist(), at.tolist())]
        key = _doc_key(ident, text)
        yield [key] * len(at), at.tolist(), low.tolist(), high.tolist(), rank.tolist(), [p[0] for p in pairs], [p[1] for p in pairs], _mark(key, at).tolist()

    second = _scan(docs, repeating, stretches, _DOC + _longs("at", "low", "high", "rank", "left", "right", "mark"), id_col, text_col)
    second = written(second.join(may_repeat, "rank", "left_semi") if may is None else second, "stretches")

    opened = written(_open_classes(second, "rank", "mark", "_doc", "at"), "open")
    marks = Sieve.of(opened, "mark", map_bits)

    # --- contexts: the bytes around the anchors that are still open, numbered as they are written
    shape = _DOC + _longs("at", "low", "high") + [("bytes", "binary", pa.binary())]

    owners = Sieve.of(written(opened.select(F.xxhash64("_doc").alias("number")).distinct(), "owners"), "number", map_bits)

    def contexts(ident, text, found, *chosen):
        at, low, high = found
        key, view = _doc_key(ident, text), memoryview(text)
        go = np.flatnonzero(np.isin(at, chosen[0])) if chosen else np.flatnonzero(_may(marks, _mark(key, at)))
        go = go.tolist()
        yield [key] * len(go), at[go].tolist(), low[go].tolist(), high[go].tolist(), [bytes(view[low[k] : high[k] + length]) for k in go]

    if marks is None:
        of_doc = opened.groupBy("_doc").agg(F.collect_set("at").alias("_at"))  # one document's anchors
        held = _scan(_keyed(docs, id_col, text_col).join(of_doc, "_doc"), every, contexts, shape, "_id", "_text", ("_at",))
    else:
        held = _scan(docs, _of_owners(owners, lambda texts: anchors_of(texts, length, prefix)), contexts, shape, id_col, text_col)
    held = written(held.withColumn("context", F.monotonically_increasing_id()), "contexts")

    def blocks_of(at: int, low: int, high: int) -> Iterator[tuple[int, int, int]]:
        """(number, first, last): windows whose anchor lies number * block to number * block + block - 1 bytes behind their start."""
        for n in range((at - high) // block, (at - low) // block + 1):
            yield n, max(low, at - n * block - block + 1), min(high, at - n * block)

    def shared(view: memoryview, at: int, low: int, n: int) -> int:
        """Rank of what all windows of a block have in common."""
        near = at - n * block - low
        return _rank(view[near : near - block + 1 + length]) ^ n

    def over_contexts(rows: DataFrame, per_batch: Callable[..., list], names: tuple[str, ...], size: int = 4_000_000) -> DataFrame:
        """Rows of longs made from a batch of contexts: ``per_batch`` returns a sequence of values a column."""
        columns = ("context", "at", "low", "high", "bytes", *(c for c in rows.columns if c == "_numbers"))

        def scanned(batches):
            for batch in batches_of(batches, size):
                context, at, low, high, parts, *numbers = (c.to_pylist() for c in batch.columns)
                made = per_batch(context, at, low, high, [memoryview(x) for x in parts], *numbers)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=list(names))

        return rows.select(*columns).mapInArrow(scanned, ", ".join(f"{n} long" for n in names))

    def shared_ranks(context, at, low, high, views):
        return [[shared(view, c, a, n) for c, a, b, view in zip(at, low, high, views, strict=True) for n in range((c - b) // block, (c - a) // block + 1)]]

    may_share = written(_repeated(over_contexts(held, shared_ranks, ("rank",)), "rank"), "ranks")
    sharing = Sieve.of(may_share, "rank", map_bits)

    def blocks(context, at, low, high, views):
        """For every block that may share its middle, the rank of that and the rank pair of the stretch it covers."""
        own = [(k, n, a, b) for k in range(len(at)) for n, a, b in blocks_of(at[k], low[k], high[k])]
        ranks = [shared(views[k], at[k], low[k], n) for k, n, _, _ in own]
        go = np.flatnonzero(_may(sharing, ranks)).tolist()
        own, ranks = [own[i] for i in go], [ranks[i] for i in go]
        pairs = [_pair(views[k][a - low[k] : b - low[k] + length], n << 32 | (at[k] - a) << 16 | b - a) for k, n, a, b in own]
        of, numbers = [context[k] for k, *_ in own], [n for _, n, _, _ in own]
        return [of, numbers, [a for *_, a, _ in own], [b for *_, b in own], ranks, [p[0] for p in pairs], [p[1] for p in pairs], _mark(of, numbers)]

    third = over_contexts(held, blocks, ("context", "number", "low", "high", "rank", "left", "right", "mark"))
    third = written(third.join(may_share, "rank", "left_semi") if sharing is None else third, "blocks")

    open_blocks = written(_open_classes(third, "rank", "mark", "context", "number"), "open")
    some = Sieve.of(open_blocks, "mark", map_bits)

    def windows(context, at, low, high, views, numbers=None):
        """Single windows of the blocks still open."""
        own = [(k, n, a, b) for k in range(len(at)) for n, a, b in blocks_of(at[k], low[k], high[k])]
        go = [n in numbers[k] for k, n, _, _ in own] if numbers is not None else _may(some, _mark([context[k] for k, *_ in own], [n for _, n, _, _ in own])).tolist()
        single = [(k, p) for (k, _, a, b), open_ in zip(own, go, strict=True) if open_ for p in range(a, b + 1)]
        pairs = [_pair(views[k][p - low[k] : p - low[k] + length], at[k] - p) for k, p in single]
        return [[context[k] for k, _ in single], [p for _, p in single], [p[0] for p in pairs], [p[1] for p in pairs]]

    left = held if some is not None else held.join(open_blocks.groupBy("context").agg(F.collect_set("number").alias("_numbers")), "context")
    fourth = over_contexts(left, windows, ("context", "low", "left", "right"), 1_000_000)
    fourth = written(fourth.withColumn("high", F.col("low")), "windows")

    spans = None
    names = held.select("context", "_doc")
    for level in (second, third, fourth):
        same = written(_repeated(level, "left", "right"), "repeated")  # written, so that the join may be split where a pair is frequent
        found = level.join(same, ["left", "right"], "left_semi")
        found = found if "_doc" in level.columns else found.join(names, "context")
        found = found.select("_doc", F.col("low").alias("start"), (F.col("high") + length).alias("stop"))
        spans = found if spans is None else spans.unionByName(found)
    return spans


def _plain(text: bytes) -> bytes:
    """Words with one blank between; words are what lies between blanks."""
    plain = text.translate(_BLANKS).strip()
    if b"  " not in plain:
        return plain
    octets = np.frombuffer(plain, "u1")
    blank = octets == 32
    return octets[np.append(~(blank[1:] & blank[:-1]), True)].tobytes()


def word_windows(texts: list[bytes], words: int, prefix: int) -> list[tuple[memoryview, np.ndarray, Found] | None]:
    """For each text: it with single blanks, where its words start, and anchors with the first and last starts of their windows.

    Anchors and starts are numbers of words. A window's anchor is the word in it whose next eight bytes hash lowest,
    among those with ``prefix`` words of the window from there on. None where a text has fewer than ``words``.
    """
    plain = [_plain(t) for t in texts]
    found = [None] * len(texts)
    for group in _groups([len(t) if t.count(b" ") + 1 >= words else 0 for t in plain], 1):
        together = b" ".join([plain[k] for k in group])
        first = np.concatenate(([0], np.flatnonzero(np.frombuffer(together, "u1") == 32) + 1, [len(together) + 1]))
        starts = np.cumsum([0, *(len(plain[k]) + 1 for k in group)])
        bounds = np.searchsorted(first, starts)
        hashed = np.ndarray((len(together),), "<u8", together + bytes(8), strides=(1,))[first[:-1]] * _MIX
        for n, (k, one) in enumerate(zip(group, _found(hashed, bounds, words, words - prefix + 1), strict=True)):
            found[k] = memoryview(plain[k]), first[bounds[n] : bounds[n + 1] + 1] - starts[n], one
    return found


def shared_passages(docs: DataFrame, words: int = WORDS, prefix: int = WORD_PREFIX, id_col: str = "doc_id", text_col: str = "text", map_bits: int = MAP_BITS) -> DataFrame:
    """(_doc) once for each document that holds ``words`` consecutive words which another document holds too.

    ``prefix`` is at least five, so that a word's next eight bytes lie within. Blanks between words do not matter. Anchors whose
    ``prefix`` words are found in one document only leave; a stretch found in two documents marks all that have it. Only
    where a document without such a stretch has a rank in common with others are single windows compared, with one
    member of each class of stretches.
    """

    def every(idents, texts):
        return word_windows(texts, words, prefix)

    def ranked(k, one):
        view, first, (at, _, _) = one
        return _ranks(view, first[at], first[at + prefix] - 1)

    def prefixes(ident, text, found):
        yield (list(set(ranked(0, found).tolist())),)

    may_repeat = written(_repeated(_scan(docs, every, prefixes, _longs("rank"), id_col, text_col), "rank"), "ranks")
    may = Sieve.of(may_repeat, "rank", map_bits)

    def repeating(idents, texts):
        return _open(may, word_windows(texts, words, prefix), ranked)

    def stretches(ident, text, found):
        (view, first, (at, low, high)), rank, go = found
        at, low, high = at[go], low[go], high[go]
        places = (x.tolist() for x in (first[low], first[high + words] - 1, (at - low) << 20 | high - low, at, rank[go]))
        once = {}  # a stretch once a document
        for a, b, shape, anchor, r in zip(*places, strict=True):
            once.setdefault(_pair(view[a:b], shape), (anchor, r))
        key, of = _doc_key(ident, text), [c for c, _ in once.values()]
        yield [key] * len(of), of, [r for _, r in once.values()], [p[0] for p in once], [p[1] for p in once], _mark(key, of).tolist()

    second = _scan(docs, repeating, stretches, _DOC + _longs("at", "rank", "left", "right", "mark"), id_col, text_col)
    second = written(second.join(may_repeat, "rank", "left_semi") if may is None else second, "stretches")
    same = written(_repeated(second, "left", "right"), "repeated")
    marked = written(second.join(same, ["left", "right"], "left_semi").select("_doc").distinct(), "marked")
    asked = written(second.join(marked, "_doc", "left_anti").select("rank").distinct(), "asked")
    opened = written(_open_classes(second.join(asked, "rank", "left_semi"), "rank", "mark", "_doc", "at"), "open")
    marks = Sieve.of(opened, "mark", map_bits)
    owners = Sieve.of(written(opened.select(F.xxhash64("_doc").alias("number")).distinct(), "owners"), "number", map_bits)

    def windows(ident, text, found, *chosen):
        key = _doc_key(ident, text)
        view, first, (at, low, high) = found
        go = np.flatnonzero(np.isin(at, chosen[0])) if chosen else np.flatnonzero(_may(marks, _mark(key, at)))
        if len(go):
            own = np.concatenate([np.arange(low[k], high[k] + 1) for k in go.tolist()])
            pairs = {_pair(view[a : b - 1], 0) for a, b in zip(first[own].tolist(), first[own + words].tolist(), strict=True)}  # once a document
            yield [key] * len(pairs), [p[0] for p in pairs], [p[1] for p in pairs]

    shape = _DOC + _longs("left", "right")
    if marks is None:
        of_doc = opened.groupBy("_doc").agg(F.collect_set("at").alias("_at"))  # one document's anchors
        third = _scan(_keyed(docs, id_col, text_col).join(of_doc, "_doc"), every, windows, shape, "_id", "_text", ("_at",))
    else:
        third = _scan(docs, _of_owners(owners, lambda texts: word_windows(texts, words, prefix)), windows, shape, id_col, text_col)
    third = written(third, "windows")  # rows that share a key are copies, so marked already
    same = written(_repeated(third, "left", "right"), "repeated")
    return marked.unionByName(third.join(same, ["left", "right"], "left_semi").select("_doc")).distinct()


def _keyed(docs: DataFrame, id_col: str, text_col: str, sieve: Broadcast | None = None, wanted: bool = True) -> DataFrame:
    """(_id, _text as bytes, _doc) of the documents; with a sieve, of those that it lets through, or of the others."""
    def keyed(batches):
        for batch in batches_of(batches):
            rows = text_bytes(batch.column(1))
            keys = [_doc_key(i, t) for i, t in zip(batch.column(0).to_pylist(), rows, strict=True)]
            hit = np.arange(len(rows))
            if sieve is not None:
                hit = np.flatnonzero(_may(sieve, [_number(k) for k in keys]) == wanted)
            if len(hit):
                chosen = hit.tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit)), pa.array([rows[k] for k in chosen], pa.binary()), pa.array([keys[k] for k in chosen], pa.binary())], names=["_id", "_text", "_doc"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text")).mapInArrow(keyed, f"_id {kind}, _text binary, _doc binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", map_bits: int = MAP_BITS, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, spans (removed, merged: array of start and stop byte), kept (binary), shares_passage.

    Texts are UTF-8 bytes, null counts as empty; strings do not reach over documents. A text shorter than ``length``
    loses nothing. Repeated rows are documents of their own, so they repeat each other; null and repeated ids are ids
    like others. Spans may cut characters: what is kept is bytes. Texts without spans never leave their scan, unless
    the documents with spans are too many for a sieve. ``shares_passage`` says whether another row holds ``words``
    consecutive words of this one (:func:`shared_passages`); such words are kept where they have fewer bytes than ``length``.
    """
    spans = repeated_spans(docs, length, prefix, block, id_col, text_col, map_bits)
    sharing = shared_passages(docs, words, id_col=id_col, text_col=text_col, map_bits=map_bits)
    span = F.struct("start", "stop").alias("_span")
    both = spans.select("_doc", span, F.lit(False).alias("_shares")).unionByName(sharing.select("_doc", F.lit(None).alias("_span"), F.lit(True).alias("_shares")))
    of_doc = written(both.groupBy("_doc").agg(F.collect_set("_span").alias("_found"), F.bool_or("_shares").alias("_shares")), "spans")  # one document's spans, once however often it is repeated
    cut = Sieve.of(of_doc.select(F.xxhash64("_doc").alias("number")), "number", map_bits)
    kind = docs.schema[id_col].dataType.simpleString()
    removed = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def shorten(batches):
        for batch in batches_of(batches):
            merged, kept, sizes = [], [], []
            for text, found in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for s in sorted((x["start"], x["stop"]) for x in found or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                at, parts = 0, []
                for a, b in runs:
                    parts.append(text[at:a])
                    at = b
                kept.append(b"".join([*parts, text[at:]]))
                merged.append([{"start": a, "stop": b} for a, b in runs])
                sizes.append(len(text))
            shares = [x is True for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(merged, removed), pa.array(kept, pa.binary()), pa.array(shares)], names=[id_col, "n_bytes", "spans", "kept", "shares_passage"])

    shape = f"`{id_col}` {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary, shares_passage boolean"
    touched = _keyed(docs, id_col, text_col, cut).join(of_doc, "_doc", "left").select("_id", "_text", "_found", "_shares").mapInArrow(shorten, shape)
    if cut is None:
        return touched
    plain = _keyed(docs, id_col, text_col, cut, wanted=False)
    return touched.unionByName(plain.select(F.col("_id").alias(id_col), F.octet_length("_text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"), F.col("_text").alias("kept"), F.lit(False).alias("shares_passage")))


def doubled_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, start, stop): the spans to remove, by prefix doubling over every byte position.

    The rank of a string of one byte is the byte. A round pairs the rank at a position with that at the offset of its
    length, sorts the pairs that occur more than once and numbers them in that order: the ranks of strings twice as
    long. Positions that are unique, or whose longer string would leave the document, are out. The last round overlaps,
    so that the length is met. Built of DataFrame functions alone.
    """
    texts = docs.select(F.col(id_col), F.hex(F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8")).alias("_hex"))
    texts = written(texts.withColumn("_row", F.monotonically_increasing_id()), "rows")
    size = (F.length("_hex") / 2).cast("int")
    byte = lambda k: F.conv(F.substring(F.col("_hex"), 2 * k + 1, F.lit(2)), 16, 10).cast("long")
    every = F.transform(F.sequence(F.lit(0), size - 1), byte)
    ranks = written(texts.where(size >= length).select("_row", F.posexplode(every).alias("at", "rank")), "ranks")
    reached = 1
    while reached < length:
        step = min(reached, length - reached)
        after = ranks.select("_row", (F.col("at") - step).alias("at"), F.col("rank").alias("after"))
        pairs = written(ranks.join(after, ["_row", "at"]), "pairs")
        order = _repeated(pairs, "rank", "after").orderBy("rank", "after").withColumn("_new", F.monotonically_increasing_id())
        ranks = written(pairs.join(written(order, "order"), ["rank", "after"]).select("_row", "at", F.col("_new").alias("rank")), "ranks")
        reached += step
    return ranks.join(texts.select("_row", id_col), "_row").select(id_col, "_row", F.col("at").alias("start"), (F.col("at") + length).alias("stop"))


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "shares_passage")
