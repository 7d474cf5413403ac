"""Best-fit packing of documents into token sequences, after a Martello-Toth dominance reduction.

A document becomes its token ids and a closing id; only longer ones are cut, into full sequences and a rest. What is
left to decide depends on piece lengths alone, so the instance is a histogram with at most ``capacity`` entries,
whatever the number of documents. On it the driver

1. fixes piece sets that provably dominate every alternative holding their largest piece (Martello and Toth's reduction
   by sets of up to three pieces): a piece that nothing fits beside; two pieces that fill a sequence; a piece and the
   largest that fits beside it, when no two others fit, or none that are together longer; a piece and a best pair, when
   no three others fit and no other pair is longer and neither member could be larger;
2. packs the remainder best-fit, longest first, treating sequences of equal content as one entry with a count.

The plan, a list of (content, count), is bounded by the number of lengths. Pieces then find their place from their rank
among pieces of equal length; ranks are counted per salt, so a length that a third of all pieces share is no hot key.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import batches_of, shuffle_width, table, text_bytes, written

CAPACITY = 2048
END_ID = 0
#: Distinct white-space-free strings whose ids a worker remembers before it starts afresh.
MEMO = 1_500_000
_BLANKS = bytes.maketrans(b"\t\n\r", b"   ")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\r", b"abcdefghijklmnopqrstuvwxyz   ")
_TAIL = b".,#$%&*!?;:"


class WordIds:
    """Token ids of whole texts, by words.

    For tokenizers whose pre-tokenizer never joins text across white space, nor a letter or digit to a sign, the ids of a
    text are those of its white-space-separated strings one after another, and those of a string ending in signs are
    those of its stem and of its tail. Each distinct stem is encoded once by the library. Where the tokenizer lowers
    case, A-Z are lowered first, unless the text holds what could be a special string or a combining mark that joins a
    letter of one case only.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[bytes, bytes] = {b"": b""}
        self.lowers = self.tokenizer.encode("ABC", add_special_tokens=False).ids == self.tokenizer.encode("abc", add_special_tokens=False).ids

        self.mark = np.array(self.tokenizer.encode("\0", add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[bytes]) -> None:
        stems = {}
        for w in words:
            stem = w.rstrip(_TAIL)
            if len(stem) < len(w) and stem[-1:].isalnum():  # of bytes: an ASCII letter or digit
                stems[w] = stem
        memo = self.memo
        parts = {p for w, stem in stems.items() for p in (stem, w[len(stem) :])} | {w for w in words if w not in stems}
        self.encode([p for p in parts if p not in memo])
        for w, stem in stems.items():
            memo[w] = memo[stem] + memo[w[len(stem) :]]

    def encode(self, words: list[bytes], group: int = 1000) -> None:
        """Encodes unseen strings a thousand to a call, told apart by a NUL between them where NUL is one token."""
        plain = [w for w in words if b"\0" not in w] if len(self.mark) == 1 else []
        encode = self.tokenizer.encode_batch_fast
        for at in range(0, len(plain), 20 * group):
            groups = [plain[k : k + group] for k in range(at, min(at + 20 * group, len(plain)), group)]
            for part, coded in zip(groups, encode([b" \0 ".join(part).decode("utf-8", "replace") for part in groups], add_special_tokens=False), strict=True):
                ids = np.array(coded.ids, "<u4")
                ends = np.flatnonzero(ids == self.mark[0])
                packed = ids.tobytes()
                for word, a, b in zip(part, [0, *(4 * (ends + 1)).tolist()], [*(4 * ends).tolist(), len(packed)], strict=True):
                    self.memo[word] = packed[a:b]
        rest = [w for w in words if w not in self.memo]
        for w, coded in zip(rest, encode([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False), strict=True):
            self.memo[w] = np.array(coded.ids, "<u4").tobytes()

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for text in texts:
            lower = self.lowers and b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text
            words = text.translate(_LOWER if lower else _BLANKS).split(b" ")
            memo = self.memo
            try:
                yield b"".join([memo[w] for w in words])
            except KeyError:
                new = list({w for w in words if w not in memo})
                if len(memo) + len(new) > MEMO:
                    memo.clear()
                    memo[b""] = b""
                    new = list(set(words) - {b""})
                self.learn(new)
                yield b"".join([memo[w] for w in words])


_coders: dict[str, WordIds] = {}


def coder(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _coders:
        _coders[path] = WordIds(path)
    return _coders[path]


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every text: id, piece, start, length, ids_crc32. A null or empty text has the closing id alone."""
    closing = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        for batch in batches_of(batches):
            ids, out = batch.column(0).to_pylist(), ([], [], [], [], [])
            for ident, coded in zip(ids, coder(tokenizer_path)(text_bytes(batch.column(1))), strict=True):
                coded += closing
                for n, at in enumerate(range(0, len(coded), 4 * capacity)):
                    part = coded[at : at + 4 * capacity]
                    for column, x in zip(out, (ident, n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=names)

    names = [id_col, "piece", "start", "length", "ids_crc32"]
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col], df[text_col].cast("string")).mapInArrow(cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def reduce_instance(count: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Dominance reduction of a histogram: the sets fixed, with counts, and what remains."""
    left = Counter({k: v for k, v in count.items() if v > 0})
    fixed: list[tuple[tuple[int, ...], int]] = []
    sizes = sorted(left)

    def take(content: tuple[int, ...], n: int) -> None:
        fixed.append((content, n))
        for size, times in Counter(content).items():
            left[size] -= n * times
            if left[size] == 0:
                del left[size]
                sizes.remove(size)

    def upto(limit: int, without: Counter) -> int:
        """The largest length left, at most ``limit``, besides ``without``; 0 if none."""
        at = bisect_right(sizes, limit) - 1
        while at >= 0 and left[sizes[at]] <= without[sizes[at]]:
            at -= 1
        return sizes[at] if at >= 0 else 0

    def smallest(n: int, without: Counter) -> int:
        """Sum of the n smallest left; above capacity if there are fewer."""
        total = 0
        for size in sizes:
            take_n = min(n, left[size] - without[size])
            total, n = total + size * take_n, n - take_n
            if n == 0:
                return total
        return total + n * (capacity + 1)

    def longest_pair(limit: int, without: Counter) -> tuple[int, int]:
        """Two lengths left with the largest sum up to ``limit``, the larger as large as can be."""
        best = (0, 0)
        for a in reversed(sizes[: bisect_right(sizes, limit)]):
            if 2 * a < sum(best) or left[a] <= without[a]:
                if 2 * a < sum(best):
                    break
                continue
            b = upto(min(a, limit - a), without + Counter([a]))
            if b and a + b > sum(best):
                best = (a, b)
        return best

    for size in sorted(left, reverse=True):
        while left[size] > 0:
            own = Counter([size])
            room = capacity - size
            one = upto(room, own)
            if one == 0:
                take((size,), left[size])
            elif one == room:
                n = left[size] // 2 if one == size else min(left[size], left[one])
                take((size, one), n)
            elif smallest(2, own) > room or (sum(longest_pair(room, own)) <= one and smallest(3, own) > room):
                n = left[size] // 2 if one == size else min(left[size], left[one])
                # beyond the first, the rule must hold anew; with the same smallest pieces left it does
                take((size, one), n if smallest(2, own) > room else 1)
            elif smallest(3, own) > room:
                a, b = longest_pair(room, own)
                if a + b == room and a == one:
                    take((size, a, b), 1)
                else:
                    break
            else:
                break
    return fixed, dict(left)


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit, longest first, over a histogram: (content, number of sequences)."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        if n:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append((content, n))

    for size in sorted(count, reverse=True):
        left = count[size]
        while left:
            at = bisect_right(rooms, size - 1)
            if at < len(rooms):
                room = rooms[at]
                content, n = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
            else:
                room, content, n = capacity, (), left
            fill = room // size
            full = min(n, left // fill)
            put(room - fill * size, content + (size,) * fill, full)
            left -= full * fill
            n -= full
            if n and left and left < fill:
                put(room - left * size, content + (size,) * left, 1)
                n, left = n - 1, 0
            if content:
                put(room, content, n)
    return [x for group in by_room.values() for x in group]


def pack_lengths(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan: contents of sequences with counts, every piece in exactly one."""
    fixed, rest = reduce_instance(count, capacity)
    plan: Counter = Counter()
    for content, n in [*fixed, *best_fit(rest, capacity)]:
        plan[content] += n
    return sorted(plan.items(), reverse=True)


def pack(cut: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces; offsets of a sequence are gapless from 0.

    Repeated ids are packed as the separate rows they are. An empty table gives an empty result.
    """
    spark = cut.sparkSession
    cut = written(cut, "pieces")
    salts = 4 * shuffle_width(spark)
    cut = cut.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)).cast("int"))
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = pack_lengths(counts, capacity)
    runs: dict[int, list[tuple[int, int, int, list[int]]]] = defaultdict(list)
    first_rank, first_sequence = Counter(), 0
    for content, n in plan:
        slots, offset = defaultdict(list), 0
        for size in content:
            slots[size].append(offset)
            offset += size
        for size, offsets in slots.items():
            runs[size].append((first_rank[size], first_sequence, n, offsets))
            first_rank[size] += n * len(offsets)
        first_sequence += n
    tables = {
        size: (np.array([r[0] for r in rs]), np.array([r[1] for r in rs]), np.array([len(r[3]) for r in rs]), np.cumsum([0, *(len(r[3]) for r in rs)])[:-1], np.array([o for r in rs for o in r[3]]))
        for size, rs in runs.items()
    }
    held = spark.sparkContext.broadcast(tables)  # bounded by the number of lengths, not by the pieces
    # Ranks: within (length, salt), after the pieces of smaller salts; the salts' sums are a running sum over a table of lengths and salts.
    per_salt = cut.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = per_salt.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "piece")))
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.coalesce("_before", F.lit(0)))
    fields = [id_col, "piece", "start", "length", "ids_crc32"]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = np.zeros(len(frame), "int64"), np.zeros(len(frame), "int64")
            for size, rows in frame.groupby("length").indices.items():
                starts, sequences, width, at, offsets = held.value[size]
                rank = frame["_rank"].to_numpy()[rows]
                run = np.searchsorted(starts, rank, "right") - 1
                nth = rank - starts[run]
                sequence[rows] = sequences[run] + nth // width[run]
                offset[rows] = offsets[at[run] + nth % width[run]]
            yield frame[fields].assign(sequence_id=sequence, offset=offset)

    kind = cut.schema[id_col].dataType.simpleString()
    return ranked.select(*fields, "_rank").mapInPandas(place, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document of ``df``; one row per piece (see :func:`pieces` and :func:`pack`)."""
    return pack(pieces(df, tokenizer_path, capacity, end_id, id_col, text_col), capacity, id_col)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
