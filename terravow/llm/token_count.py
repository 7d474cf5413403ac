"""Token counts by finite-state tokenizer compilation.

A byte-pair vocabulary in which every merged piece may be formed whenever its two parts meet is compiled, as texts need
it, into a deterministic transducer over characters. What the tokenizer makes of a prefix is decided by its last tokens:
token t may end the prefix exactly where t, set beside the last token s of the prefix before it, is left alone by the
merges (s + t encodes as s, t). So a state holds the openings that later characters can still turn into tokens, each
with its place in the vocabulary's tree, the token before it and its count relative to the count so far. A transition
carries the change of the token count, which may be negative where a character completes a longer piece.

A batch of texts is one array of characters cut into chunks. Where two neighbouring characters are adjacent in no
piece, no merge can cross, and the state behind them does not depend on what came before: from its first such place on,
a chunk's state map is constant. All constant tails run in lockstep through the transition table. Chunks without such
a place get maps from the states that can reach them: the exits of constant chunks, and what the maps themselves lead
to. A parallel prefix scan composes the maps of neighbours in doubling distances, which gives every chunk its entry
state, and all that is left runs in lockstep once more. Counts are sums of the transitions' changes over a text's
characters. Where more than ``STATES`` states can be reached, maps cost more than walking, and the chunks follow each
other; the counts are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches_of, table, text_bytes

LIMIT = 4096
CHUNK = 192
#: Entry states up to which the maps of chunks are built, and chunks from which on they are worth it.
STATES, SCANNED = 24, 8
#: Transitions a worker keeps from batch to batch; beyond, the compiled part is dropped and built anew. Within a batch
#: the table grows as needed.
TRANSITIONS = 1 << 20
_SPACE = "▁"


class Transducer:
    def __init__(self, pieces: dict[str, float]):
        """``pieces``: the ordinary pieces with their scores; a higher score merges first."""
        self.score = pieces
        self.names = list(pieces)
        self.number = {p: i for i, p in enumerate(self.names)}
        chars = sorted({c for p in pieces for c in p})
        lone = [c for c in chars if c not in pieces]
        if lone:
            raise ValueError(f"characters that occur in pieces only: {lone[:5]}")
        # classes 1 to 4: characters in no piece, by their UTF-8 bytes; then one for each character
        self.chars = [None] * 5 + chars
        self.class_of = np.zeros(0x110000, "u2")
        self.class_of[:0x80], self.class_of[0x80:0x800], self.class_of[0x800:0x10000], self.class_of[0x10000:] = 1, 2, 3, 4
        self.class_of[[ord(c) for c in chars]] = np.arange(5, 5 + len(chars))
        self.adjacent = np.zeros((len(self.chars), len(self.chars)), bool)
        self.children: list[dict[str, int]] = [{}]
        self.token: list[int] = [-1]
        for p in self.names:
            node = 0
            for c in p:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = self.children[node][c]
            self.token[node] = self.number[p]
            codes = self.class_of[[ord(c) for c in p]]
            self.adjacent[codes[:-1], codes[1:]] = True
        self.pairs: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drops the compiled states; state 0 is that before a text."""
        self.states: list[tuple] = [(-1, ())]
        self.state_of = {self.states[0]: 0}
        self.bits, self.used = (2 * TRANSITIONS - 1).bit_length(), 0
        self.allocate()

    def allocate(self) -> None:
        self.keys = np.full(1 << self.bits, -1, "i8")
        self.next = np.zeros(1 << self.bits, "i4")
        self.change = np.zeros(1 << self.bits, "i1")

    def grow(self) -> None:
        """Doubles the table of transitions; their places change."""
        held = np.flatnonzero(self.keys >= 0)
        key, after, change = self.keys[held], self.next[held], self.change[held]
        self.bits += 1
        self.allocate()
        at, left = self.slots(key), np.arange(len(key))
        while len(left):
            empty = left[self.keys[at[left]] < 0]
            place, which = np.unique(at[empty], return_index=True)
            now = empty[which]
            self.keys[place], self.next[place], self.change[place] = key[now], after[now], change[now]
            left = left[self.keys[at[left]] != key[left]]
            at[left] = at[left] + 1 & len(self.keys) - 1

    def merged(self, text: str) -> list[str]:
        """The plain merge procedure, for two tokens side by side."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stand(self, s: int, t: int) -> bool:
        """Whether token t may follow token s (-1: nothing that could merge)."""
        if s < 0:
            return True
        key = (s, t)
        if key not in self.pairs:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[key] = self.merged(self.names[s] + self.names[t]) == [self.names[s], self.names[t]]
        return self.pairs[key]

    def step(self, state: tuple, code: int) -> tuple[tuple, int]:
        """The state after a character of class ``code``, and the change of the count."""
        if code < 5:
            return self.states[0], code
        char, (last, openings) = self.chars[code], state
        if last >= 0 and not self.adjacent[self.class_of[ord(self.names[last][-1])], code]:
            last, openings = -1, ()
        grown, ended, change = [], -1, 0
        for node, before, count in (*openings, (0, last, 0)):
            child = self.children[node].get(char)
            if child is None:
                continue
            t = self.token[child]
            if t >= 0 and ended < 0 and self.stand(before, t):
                ended, change = t, count + 1
            if self.children[child]:
                grown.append((child, before, count))
        return (ended, tuple((node, before, count - change) for node, before, count in grown)), change

    def add(self, state: int, code: int) -> tuple[int, int]:
        after, change = self.step(self.states[state], code)
        number = self.state_of.get(after)
        if number is None:
            number = self.state_of[after] = len(self.states)
            self.states.append(after)
        if 2 * self.used >= len(self.keys):
            self.grow()
        key = state << 16 | code
        at = self.slot(key)
        while self.keys[at] >= 0:
            if self.keys[at] == key:
                return number, change
            at = at + 1 & len(self.keys) - 1
        self.keys[at], self.next[at], self.change[at] = key, number, change
        self.used += 1
        return number, change

    def slot(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits

    def slots(self, key: np.ndarray) -> np.ndarray:
        return (key.view("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view("i8")

    def follow(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Transitions of many states at once; those not compiled yet are."""
        key = state << 16 | code
        at, bits = self.slots(key), self.bits
        found = self.keys.take(at)
        odd = np.flatnonzero(found != key)
        while len(odd):
            empty = found[odd] < 0
            if empty.any():
                for missing in np.unique(key[odd[empty]]).tolist():
                    self.add(missing >> 16, missing & 0xFFFF)
                if self.bits != bits:  # the table has grown, and every place changed
                    return self.follow(state, code)
                at[odd] = self.slots(key[odd])
            else:
                at[odd] = at[odd] + 1 & len(self.keys) - 1
            found[odd] = self.keys[at[odd]]
            odd = odd[found[odd] != key[odd]]
        return self.next.take(at).astype("i8"), self.change.take(at)

    def run(self, codes: np.ndarray, changes: np.ndarray, start: np.ndarray, stop: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Runs lanes [start, stop) from their states in lockstep, fills in changes; returns the exit states."""
        out, lanes = state.copy(), np.argsort(start - stop, kind="stable")  # longest first
        length = (stop - start)[lanes]
        if len(lanes) < 24:
            for lane in lanes.tolist():
                now = int(out[lane])
                for at in range(int(start[lane]), int(stop[lane])):
                    now, changes[at] = self.one(now, int(codes[at]))
                out[lane] = now
            return out
        active, begin = state[lanes], start[lanes]
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -t))  # lanes with more than t characters
            if n < len(active):
                out[lanes[n : len(active)]] = active[n:]
                active = active[:n]
            at = begin[:n] + t
            active, change = self.follow(active, codes[at])
            changes[at] = change
        out[lanes[: len(active)]] = active
        return out

    def one(self, state: int, code: int) -> tuple[int, int]:
        key = state << 16 | code
        at = self.slot(key)
        while (held := self.keys[at]) != key:
            if held < 0:
                return self.add(state, code)
            at = at + 1 & len(self.keys) - 1
        return int(self.next[at]), int(self.change[at])

    def scan(self, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray, exits: np.ndarray, chunks: np.ndarray) -> None:
        """Fills in the exits of ``chunks``, which have no free place; the chunks before runs of them have theirs."""
        first = np.concatenate(([True], np.diff(chunks) > 1))
        new = np.unique(exits[chunks[first] - 1])
        states, maps, scratch = np.zeros(0, "i8"), np.zeros((len(chunks), 0), "i8"), np.zeros(len(codes), "i1")
        while len(new):
            if len(states) + len(new) > STATES:
                return
            lanes = np.repeat(chunks, len(new))
            out = self.run(codes, scratch, starts[lanes], stops[lanes], np.tile(new, len(chunks)))
            states, maps = np.concatenate((states, new)), np.hstack((maps, out.reshape(len(chunks), -1)))
            new = np.setdiff1d(out, states)
        order = np.argsort(states)
        maps = order[np.searchsorted(states, maps, sorter=order)]  # from place to place in ``states``
        place, step = np.arange(len(chunks)), 1
        begins = np.maximum.accumulate(np.where(first, place, 0))
        while step < len(chunks):
            open_ = np.flatnonzero(place - step >= begins)
            maps[open_] = np.take_along_axis(maps[open_], maps[open_ - step], axis=1)
            step *= 2
        entry = order[np.searchsorted(states, exits[chunks[begins] - 1], sorter=order)]
        exits[chunks] = states[maps[place, entry]]

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        if self.used > TRANSITIONS or len(self.states) > 1 << 22:
            self.forget()
        filled = [i for i, t in enumerate(texts) if t]
        out = np.zeros(len(texts), "i8")
        if not filled:
            return out
        decoded = ["\0" + _SPACE + texts[i].decode("utf-8", "replace").replace(" ", _SPACE) for i in filled]
        codes = self.class_of[np.frombuffer("".join(decoded).encode("utf-32-le", "surrogatepass"), "u4")].astype("i8")
        sizes = np.fromiter(map(len, decoded), "i8", len(decoded))
        first = np.cumsum(sizes) - sizes
        codes[first] = 0  # between texts: emits nothing, and leads to the state before a text
        free = np.ones(len(codes), bool)  # places whose state does not depend on what came before
        free[1:] = ~self.adjacent[codes[:-1], codes[1:]]
        changes = np.zeros(len(codes), "i1")
        starts = np.arange(0, len(codes), CHUNK)
        stops = np.minimum(starts + CHUNK, len(codes))
        places = np.flatnonzero(free)
        cut = places[np.minimum(np.searchsorted(places, starts), len(places) - 1)]
        constant = (cut >= starts) & (cut < stops)
        exits = np.full(len(starts), -1, "i8")
        known = np.flatnonzero(constant)
        # The tails of constant chunks: from a free place on, as from the state before a text.
        exits[known] = self.run(codes, changes, cut[known], stops[known], np.zeros(len(known), "i8"))
        head = np.where(constant, cut, stops)
        waiting, mapped = np.flatnonzero(head > starts), np.flatnonzero(~constant)
        if len(mapped) >= SCANNED:
            self.scan(codes, starts, stops, exits, mapped)
        while len(waiting):
            ready = exits[waiting - 1] >= 0
            now = waiting[ready]
            left = self.run(codes, changes, starts[now], head[now], exits[now - 1])
            exits[now] = np.where(constant[now], exits[now], left)
            waiting = waiting[~ready]
        out[filled] = np.add.reduceat(changes.astype("i8"), first)
        return out


def compiled(path: str) -> Transducer:
    """The transducer of a sentencepiece model, one a worker."""
    if path not in _compiled:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        _compiled[path] = Transducer({model.id_to_piece(i): model.get_score(i) for i in plain})
    return _compiled[path]


_compiled: dict[str, Transducer] = {}


def token_counts(df: DataFrame, model_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_tokens, over_limit.

    A null or empty text has no bytes and no tokens. Texts are counted whole, whatever their length; rows may repeat.
    """

    def counted(batches):
        for batch in batches_of(batches, 3_000_000):
            texts = text_bytes(batch.column(1))
            tokens = compiled(model_path).counts(texts)
            sizes = np.fromiter(map(len, texts), "i8", len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col], df[text_col].cast("string")).mapInArrow(counted, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_count(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
