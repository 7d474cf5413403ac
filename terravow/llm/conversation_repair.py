"""Conversation structure repair: the cheapest edits that make a conversation's roles legal, by a persistent audit DP.

Rows are damaged by a hash, faults are found, and each conversation is repaired so that its role initials read
``(s?(ua)+)?``. Rows come sorted by conversation and turn, and a conversation is read as a stream: its texts are never
held together. Four states (nothing yet, after a system, a user, an assistant row) each keep their cheapest edits.

Edits are linked nodes, so states share the prefixes they have in common. A node has its depth, the rolling hash of the
edits up to it, and its ancestors 1, 2, 4, 8, ... edits back. Of two equally cheap lists of edits the least in ASCII
order wins: their longest common prefix is searched through ancestors of equal hash, the edits up to it are then
compared themselves, so a collision of hashes cannot decide. Two candidates for a state have the same number of row
edits and end in one, so neither is a proper prefix of the other and the choice stands whatever follows.

What the states agree upon is written out and forgotten, and a state too dear to win is dropped, so memory follows the
undecided stretch. The text hash runs along with each state. A conversation is one value of the result, so one task
walks it; there is no other group that a task must hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import batches_of, table

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role's initial leads from each state.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where an inserted or rewritten row leads, and its role.
FORCED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: b"user:", ASSISTANT: b"assistant:"}
LEGAL_PAIRS = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A state may do what a dearer one does after at most this many more units, so beyond it the dearer one cannot win.
SLACK = 5
_PRIME, _BASE = (1 << 61) - 1, 911382323
_SETTLE = 512


class Edits:
    """A tree of edits. Node 0 is the root; a node is a list of edits, shared with all that continue it."""

    def __init__(self) -> None:
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[0]]

    def add(self, parent: int, letter: str) -> int:
        node, ups, at = len(self.letter), [parent], 0
        while len(self.up[ups[at]]) > at and ups[at]:
            ups.append(self.up[ups[at]][at])
            at += 1
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + ord(letter)) % _PRIME)
        self.up.append(ups)
        return node

    def _lifted(self, node: int, steps: int) -> int:
        at = 0
        while steps:
            if steps & 1:
                node = self.up[node][at]
            steps, at = steps >> 1, at + 1
        return node

    def _same(self, a: int, b: int) -> bool:
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def text(self, node: int, above: int = 0) -> str:
        """The edits from ``above`` to ``node``."""
        found = []
        while node != above:
            found.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(found))

    def before(self, a: int, end_a: str, b: int, end_b: str) -> bool:
        """Whether the edits of a, then end_a, come before those of b, then end_b."""
        if a == b:
            return end_a < end_b
        level = min(self.depth[a], self.depth[b])
        x, y = self._lifted(a, self.depth[a] - level), self._lifted(b, self.depth[b] - level)
        if self.hash[x] == self.hash[y]:
            common, next_a, next_b = (x, y), self._next(a, level, end_a), self._next(b, level, end_b)
        else:
            for at in range(max(len(self.up[x]), len(self.up[y])) - 1, -1, -1):
                if at < len(self.up[x]) and at < len(self.up[y]) and self.hash[self.up[x][at]] != self.hash[self.up[y][at]]:
                    x, y = self.up[x][at], self.up[y][at]
            common, next_a, next_b = (self.up[x][0], self.up[y][0]), self.letter[x], self.letter[y]
        if next_a == next_b or not self._same(*common):  # hashes that collide, or one list that goes on
            return self.text(a) + end_a < self.text(b) + end_b
        return next_a < next_b

    def _next(self, node: int, level: int, end: str) -> str:
        return end if self.depth[node] == level else self.letter[self._lifted(node, self.depth[node] - level - 1)]

    def shared(self, nodes: list[int]) -> int:
        """The last node that all ``nodes`` go through."""
        first, *others = nodes
        for node in others:
            a, b = first, node
            while a != b:
                if self.depth[a] >= self.depth[b]:
                    a = self.up[a][0]
                else:
                    b = self.up[b][0]
            first = a
        return first


class Repair:
    """One conversation, row by row."""

    def __init__(self) -> None:
        self.edits, self.settled = Edits(), []
        self.live: dict[int, tuple[int, int, object, bool]] = {START: (0, 0, hashlib.sha256(), False)}
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = self.turn = None
        self.turns, self.initial = 0, None

    def _best(self, now: tuple | None, cost: int, node: int, letter: str, *what) -> tuple:
        if now is None or cost < now[0] or cost == now[0] and self.edits.before(node, letter, now[1], now[2]):
            return (cost, node, letter, *what)
        return now

    def _grown(self, found: tuple) -> tuple[int, int, object, bool]:
        cost, parent, letter, digest, some, said = found
        if said is not None:
            digest = digest.copy()
            digest.update(b"\n" + said if some else said)
        return cost, self.edits.add(parent, letter), digest, some or said is not None

    def _inserted(self) -> dict[int, tuple[int, int, object, bool]]:
        """The states after any insertions. A state is reached by at most two in a row: a user row, then an assistant row."""
        live = dict(self.live)
        for target, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            best = None
            for source in sources:
                if source in live:
                    cost, node, digest, some = live[source]
                    best = self._best(best, cost + INSERT, node, "I", digest, some, ROLES[target])
            if best is not None:
                own = live.get(target)
                if own is None or best[0] < own[0] or best[0] == own[0] and self.edits.before(best[1], "I", own[1], ""):
                    live[target] = self._grown(best)
        return live

    def row(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        self.rows += 1
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.turns += turn != self.turn
            self.turn = turn
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL_PAIRS
        self.initial = initial
        said = text.rstrip(SPACE)
        blank, duplicate = not said, bool(said) and repeated
        truncated = not blank and not duplicate and said[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        must_go, extra, body = blank or duplicate, TRUNCATED * truncated, text.encode("utf-8", "surrogatepass")
        best: dict[int, tuple] = {}
        for state, (cost, node, digest, some) in self._inserted().items():
            best[state] = self._best(best.get(state), cost + DELETE, node, "D", digest, some, None)
            if not must_go:
                to = STEPS.get((state, initial))
                if to is not None:
                    best[to] = self._best(best.get(to), cost + extra, node, "K", digest, some, role.encode("utf-8", "surrogatepass") + b":" + body)
                to = FORCED[state]
                best[to] = self._best(best.get(to), cost + REROLE + extra, node, "R", digest, some, ROLES[to] + body)
        bound = min(x[0] for x in best.values()) + SLACK
        self.live = {state: self._grown(x) for state, x in best.items() if x[0] <= bound}
        if self.rows % _SETTLE == 0:
            self._settle()

    def _settle(self) -> None:
        """Write out what all states agree upon, and keep only nodes that a state still goes through."""
        old, root = self.edits, self.edits.shared([x[1] for x in self.live.values()])
        self.settled.append(old.text(root))
        kept: set[int] = set()
        for _, node, _, _ in self.live.values():
            while node != root and node not in kept:
                kept.add(node)
                node = old.up[node][0]
        self.edits, moved = Edits(), {root: 0}
        for node in sorted(kept):
            moved[node] = self.edits.add(moved[old.up[node][0]], old.letter[node])
        self.live = {state: (x[0], moved[x[1]], x[2], x[3]) for state, x in self.live.items()}

    def result(self) -> tuple:
        live = self._inserted()
        ends = [live[s] for s in (START, ASSISTANT) if s in live]
        end = ends[0]
        for other in ends[1:]:
            if other[0] < end[0] or other[0] == end[0] and self.edits.before(other[1], "", end[1], ""):
                end = other
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        audit = "".join(self.settled) + self.edits.text(end[1])
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, end[0], audit, end[2].hexdigest()


OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from rows sorted by conversation, turn, role and text."""
    now, at = None, None
    ids: list = []
    found: list[tuple] = []
    types: list[pa.DataType] = []

    def flushed() -> pa.RecordBatch:
        columns = [pa.array(ids, types[0])] + [pa.array(list(c), pa.string() if k > 5 else pa.int64()) for k, c in enumerate(zip(*found, strict=True))]
        ids.clear()
        found.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv", *_FIELDS])

    for batch in batches_of(batches):
        types[:] = [batch.schema.field(0).type]
        for conv, turn, role, text, gone, nth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != at:
                if now is not None:
                    ids.append(at)
                    found.append(now.result())
                    if len(ids) >= 4096:
                        yield flushed()
                now, at = Repair(), conv
            if not gone:
                now.row(turn, role, text, nth > 1)
    if now is not None:
        ids.append(at)
        found.append(now.result())
        yield flushed()


def damaged(convs: DataFrame, conv: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """conv, turn, role, text, gone, copy: rows after damage. Dropped rows stay, marked, so that their conversation stays."""
    fate = F.pmod(F.crc32(F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" "))).cast("binary")), F.lit(20))
    rows = convs.select(conv.alias("conv"), turn.cast("long").alias("turn"), F.coalesce(role.cast("string"), F.lit(" ")).alias("role"), F.coalesce(text.cast("string"), F.lit(" ")).alias("text"), fate.alias("fate"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv",
        "turn",
        F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fate") == 0).alias("gone"),
        F.explode(copies).alias("copy"),
    )


def unchanged(convs: DataFrame, conv: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """The rows as they are, in the shape of ``damaged``."""
    return convs.select(conv.alias("conv"), turn.cast("long").alias("turn"), F.coalesce(role.cast("string"), F.lit(" ")).alias("role"), F.coalesce(text.cast("string"), F.lit(" ")).alias("text"), F.lit(False).alias("gone"), F.lit(0).alias("copy"))


def repair(convs: DataFrame, damage: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: its faults, the cost and the audit of the cheapest edits, and the hash of the repaired text.

    Null role or text counts as one space; rows with null turn come first; rows of one turn go by role, then text. Rows
    without conversation id form one conversation of their own. A role without initial is legal nowhere. Repeated rows
    are repeated turns. ``damage`` first damages the rows. An empty table gives an empty result; other columns are
    neither read nor returned.
    """
    kind = convs.schema[conv_col].dataType.simpleString()
    rows = (damaged if damage else unchanged)(convs, convs[conv_col], convs[turn_col], convs[role_col], convs[text_col])
    # one shuffle: the window over role and text within a conversation and the stream both follow from it
    rows = rows.repartition(F.col("conv"))
    turns = [F.col("turn").asc_nulls_first(), F.col("copy")]
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "role", "text", "gone").orderBy(*turns)))
    rows = rows.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "copy").select("conv", "turn", "role", "text", "gone", "nth")
    found = rows.mapInArrow(repaired, f"conv {kind}, {OUT}")
    return found.select(F.col("conv").alias(conv_col), *_FIELDS)


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"), damage=True)


_I = "{{c: {0}.c + 2, a: {0}.a || 'I', o: list_append({0}.o, '{1}:')}}"
_NONE = "CAST({c: 1000000, a: '', o: []} AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR[]))"


def _edits(state: str, initial: dict[str, str], forced: str) -> dict[str, list[str]]:
    """Candidates by target that leave ``state`` over a row, as SQL."""
    free = "NOT must_go"
    found: dict[str, list[str]] = {state: [f"{{c: {state}.c + 3, a: {state}.a || 'D', o: {state}.o}}"]}
    for letter, to in initial.items():
        found.setdefault(to, []).append(f"CASE WHEN {free} AND role[1:1] = '{letter}' THEN {{c: {state}.c + extra, a: {state}.a || 'K', o: list_append({state}.o, role || ':' || text)}} ELSE {_NONE} END")
    said = {"s2": "user:", "s3": "assistant:"}[forced]
    found.setdefault(forced, []).append(f"CASE WHEN {free} THEN {{c: {state}.c + 2 + extra, a: {state}.a || 'R', o: list_append({state}.o, '{said}' || text)}} ELSE {_NONE} END")
    return found


def _oracle() -> str:
    into: dict[str, list[str]] = {}
    for state, initial, forced in (("s0", {"s": "s1", "u": "s2"}, "s2"), ("s1", {"u": "s2"}, "s2"), ("s2", {"a": "s3"}, "s3"), ("s3", {"u": "s2"}, "s2")):
        for to, candidates in _edits(state, initial, forced).items():
            into.setdefault(to, []).extend(candidates)
    after = ", ".join(f"list_sort([{', '.join(into[s])}])[1] AS {s}" for s in ("s0", "s1", "s2", "s3"))
    opened_user = f"list_sort([s2, {', '.join(_I.format(s, 'user') for s in ('s0', 's1', 's3'))}])[1]"
    opened = f"SELECT *, list_sort([s3, {_I.format('u2', 'assistant')}])[1] AS u3 FROM (SELECT *, {opened_user} AS u2 FROM dp)"
    return rf"""
WITH RECURSIVE crc AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id) AS g,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::BIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS v
  FROM conversations
), hit AS (
  SELECT g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(v, 4294967295) % 20 AS fate FROM crc
), late AS (
  SELECT g, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, k
  FROM hit, (VALUES (0), (1)) AS t(k) WHERE fate <> 0 AND (k = 0 OR fate = 3)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, k) AS n,
         row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, k) > 1 AS again,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said
  FROM late
), faults AS (
  SELECT *, said = '' AS is_blank, said <> '' AND again AS is_duplicate,
         said <> '' AND NOT again AND NOT regexp_matches(said, '[.!?]\z') AS is_truncated,
         coalesce(role[1:1] || lead(role[1:1]) OVER (PARTITION BY g ORDER BY n) NOT IN ('su', 'ua', 'au'), false) AS is_illegal
  FROM numbered
), counts AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_duplicate) AS duplicate,
         count(*) FILTER (is_truncated) AS truncated, count(*) FILTER (is_illegal) AS illegal, max(n) AS last
  FROM faults GROUP BY g
), dp AS (
  SELECT g, 0::BIGINT AS n, CAST({{c: 0, a: '', o: []}} AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])) AS s0, {_NONE} AS s1, {_NONE} AS s2, {_NONE} AS s3 FROM (SELECT DISTINCT g FROM hit)
  UNION ALL
  SELECT g, n, {after} FROM (
    SELECT w.g, f.n, w.s0, w.s1, w.u2 AS s2, w.u3 AS s3, f.role, f.text, f.is_blank OR f.is_duplicate AS must_go, CASE WHEN f.is_truncated THEN 1 ELSE 0 END AS extra
    FROM ({opened}) w JOIN faults f ON f.g = w.g AND f.n = w.n + 1
  )
), ended AS (
  SELECT e.g, list_sort([s0, u3])[1] AS r FROM ({opened}) e LEFT JOIN counts USING (g) WHERE n = coalesce(last, 0)
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       r.c AS cost, r.a AS audit, sha256(array_to_string(r.o, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM hit) i JOIN ended USING (g) LEFT JOIN counts USING (g)
"""


ORACLE = _oracle()
