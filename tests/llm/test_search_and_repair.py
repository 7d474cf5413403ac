"""Vector search, lexical search and conversation repair against brute force: nulls, ties, repeats, odd sizes, clashing names."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravow.llm import conversation_repair, lexical_search, vector_search

# --- vectors

VECTORS = "vec_id long, embedding array<double>, row long, pivot int, query long, score string"


def brute_vectors(rows, asked, k=5):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    held = [(i, q) for i, v in rows if (q := whole(v)) is not None]
    found = []
    for at, (i, q) in enumerate(held):
        if asked(i):
            others = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, x, strict=False)))), j is None, j) for n, (j, x) in enumerate(held) if n != at]
            others.sort(key=lambda x: (x[0], x[1], x[2] or 0))
            found += [(i, rank, j, -s) for rank, (s, _, j) in enumerate(others[:k], 1)]
    return sorted(found, key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], VECTORS).repartition(4)


@pytest.mark.parametrize("group", [vector_search.GROUP, 4])
def test_nearest_vectors(spark, monkeypatch, group):
    monkeypatch.setattr(vector_search, "BLOCK", 16)
    r = np.random.default_rng(2)
    rows = [(k, r.normal(0, 1, 6).tolist()) for k in range(150)]
    rows += [(200 + k, [0.5, -0.25, 0.0, 1.0, 0.0, 0.125]) for k in range(60)]  # one vector many times
    rows += [(300, None), (350, [1.0, None]), (400, [math.nan] * 6), (450, [math.inf]), (500, []), (550, [1.0, 2.0]), (600, [0.0] * 6), (50, [9.0] * 6), (None, [3.0] * 6), (None, [3.0] * 6)]
    found = vector_search.top_k(vectors(spark, rows), F.col("vec_id") % 10 == 0, group=group)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(x) for x in found.collect()), key=str) == brute_vectors(rows, lambda i: i is not None and i % 10 == 0)


def test_vectors_too_large_for_doubles(spark):
    r = random.Random(3)
    rows = [(k, [r.uniform(-1, 1) * 10.0 ** r.randint(-3, 30) for _ in range(4)]) for k in range(40)] + [(40, [1e305, 1.0, 1.0, 1.0]), (41, [1e308, 0.0, 0.0, 0.0])]
    found = vector_search.top_k(vectors(spark, rows), F.col("vec_id") % 2 == 0)
    assert sorted((tuple(x) for x in found.collect()), key=str) == brute_vectors(rows, lambda i: i % 2 == 0)


def test_few_vectors_and_none(spark):
    assert vector_search.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert vector_search.top_k(vectors(spark, [(0, None)]), F.col("vec_id") % 50 == 0).count() == 0
    assert vector_search.top_k(vectors(spark, [(0, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0
    rows = [(0, [1.0]), (1, [-1.0]), (2, [1.0])]
    assert sorted((tuple(x) for x in vector_search.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()), key=str) == [(0, 1, 2, 65536), (0, 2, 1, -65536)]


def test_bounds_leave_annuli_out(spark, monkeypatch):
    """In clusters far apart a group reads few annuli: the bound, not a limit, leaves the others."""
    monkeypatch.setattr(vector_search, "BLOCK", 16)
    r = np.random.default_rng(4)
    centres = r.normal(0, 20, (12, 8))
    rows = [(k, (centres[k % 12] + r.normal(0, 0.1, 8)).tolist()) for k in range(1200)]
    asked, within = [], vector_search._within
    monkeypatch.setattr(vector_search, "_within", lambda x: asked.append(x) or within(x))
    found = vector_search.top_k(vectors(spark, rows), F.col("vec_id") % 1200 == 0).collect()
    assert sorted((tuple(x) for x in found), key=str) == brute_vectors(rows, lambda i: i % 1200 == 0)
    assert len(asked[-1]) < vector_search.PIVOTS / 4


# --- words


def brute_words(docs, items, k=10):
    terms = lambda t: [w.lower() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")] if (t or "").isascii() else [w.translate({65 + i: 97 + i for i in range(26)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)]
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    total, df = sum(len(w) for _, w in held), collections.Counter(x for _, w in held for x in set(w))
    found = []
    for item, text in items:
        scores = []
        for i, words in held:
            tf, m = collections.Counter(words), 100 - 75 + (75 * len(words) * len(held)) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in terms(text) if tf[x])
            if s > 0:
                scores.append((-s, i is None, i))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        found += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(scores[:k], 1)]
    return sorted(found, key=str)


@pytest.mark.parametrize("block_bytes", [lexical_search.BLOCK_BYTES, 60])
def test_ranked_documents(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(lexical_search, "TILE_DOCS", 7)
    monkeypatch.setattr(lexical_search, "TILE_ITEMS", 3)
    r = random.Random(6)
    words = ["alpha", "Beta", "GAMMA", "dé", "ÉTÉ", "x1", "été", "zeta", "eta"]
    text = lambda n: " ".join(r.choice(words) + r.choice(["", ",", "_", "."]) for _ in range(n))
    docs = [(k, text(r.randint(0, 60))) for k in range(80)] + [(100 + k, "alpha beta alpha") for k in range(30)]
    docs += [(None, "zeta eta"), (None, None), (5, "alpha"), (5, "alpha"), (500, text(40_000)), (501, "_ - ."), (502, "")]
    items = [(k, text(r.randint(0, 12))) for k in range(9)] + [(3, "alpha beta"), (None, "zeta zeta zeta"), (50, None), (51, "unknown"), (52, "alpha " * 500)]
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in docs], "doc_id long, text string, score int, name string").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, size int")
    found = lexical_search.ranked(df, asked, block_bytes=block_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(x) for x in found.collect()), key=str) == brute_words(docs, items)


def test_products_stay_exact():
    r = np.random.default_rng(1)
    for most in (10, 2**30, 2**45):
        items, docs = r.integers(0, 40, (9, 70)).astype(float), r.integers(0, most, (11, 70)).astype(float)
        exact = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in docs] for x in items]
        assert lexical_search.exact_product(items, docs).tolist() == exact
    one = lexical_search.exact_product(np.array([[2.0**20, 3]]), np.array([[2.0**40, 5]]))
    assert one.tolist() == [[2**60 + 15]]


def test_no_documents_or_items(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.ranked(none, items).count() == 0
    assert lexical_search.ranked(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


# --- conversations

SPACE = " \t\n\x0b\x0c\r"
STEPS = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}
FORCED = {"0": ("2", "user"), "1": ("2", "user"), "2": ("3", "assistant"), "3": ("2", "user")}


def brute_repair(rows, damage):
    """From the last row back, every edit from every state, at most two insertions in a row."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        own = convs.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        role, text = "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    found = {}
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        kinds, seen = [], set()
        for _, role, text in own:
            said = text.rstrip(SPACE)
            kinds.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))

        @functools.cache
        def best(i, state, inserted=0, own=own, kinds=kinds):
            options = []
            if i == len(own):
                if state in "03":
                    options.append((0, "", ()))
            else:
                _, role, text = own[i]
                c, s, o = best(i + 1, state)
                options.append((c + 3, "D" + s, o))
                if kinds[i] not in ("blank", "duplicate"):
                    extra, choices = int(kinds[i] == "truncated"), [(2, "R", *FORCED[state])]
                    if (state, role[:1]) in STEPS:
                        choices.append((0, "K", STEPS[state, role[:1]], role))
                    for cost, letter, to, name in choices:
                        c, s, o = best(i + 1, to)
                        options.append((c + cost + extra, letter + s, (f"{name}:{text}", *o)))
            if inserted < 2:
                to, name = FORCED[state]
                c, s, o = best(i, to, inserted + 1)
                options.append((c + 2, "I" + s, (f"{name}:", *o)))
            return min(options) if options else (10**9, "", ())

        cost, audit, said = best(0, "0")
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        found[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return found


def conversations(seed, n=120):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, 12)):
            text = r.choice(["Yes.", "No", "Why?", "", " \t", "é!", "so. \n", "a", None, "Yes."])
            rows.append((conv if conv else None, r.choice([turn, turn, turn * 2, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "uncle"]), text))
    return rows


@pytest.mark.parametrize("damage", [True, False])
def test_repairs(spark, damage):
    rows = conversations(1 + damage)
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "conv_id long, turn long, role string, text string, nth int, gone int").repartition(5)
    found = {x["conv_id"]: tuple(x)[1:] for x in conversation_repair.repair(df, damage).collect()}
    assert found == brute_repair(rows, damage)


def walked(rows):
    now, seen = conversation_repair.Repair(), set()
    for turn, role, text in rows:
        now.row(turn, role, text, (role, text) in seen)
        seen.add((role, text))
    return now.result()


@pytest.mark.parametrize("prime", [conversation_repair._PRIME, 1, 2, 3])
def test_ties_and_colliding_hashes(monkeypatch, prime):
    """Of equally cheap edits the least in ASCII order, also where all hashes are equal."""
    monkeypatch.setattr(conversation_repair, "_PRIME", prime)
    r = random.Random(prime)
    for _ in range(150):
        rows = [(k, r.choice(["user", "assistant", "tool"]), f"{k}.") for k in range(r.randint(0, 9))]
        assert walked(rows) == brute_repair([(0, *x) for x in rows], False).get(0, (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()))


def test_long_conversations_are_settled(monkeypatch):
    r = random.Random(9)
    rows = [(k, r.choice(["user", "assistant", "assistant", "system"]), f"{k}" + r.choice([".", "", "!"])) for k in range(400)]
    odd = [(k, "tool", f"{k}.") for k in range(300)]  # no two states ever share an edit but the first
    expected = [brute_repair([(0, *x) for x in y], False)[0] for y in (rows, odd)]
    monkeypatch.setattr(conversation_repair, "_SETTLE", 7)
    assert [walked(rows), walked(odd)] == expected


def test_all_rows_dropped_or_none(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert tuple(conversation_repair.repair(df, damage=True).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert conversation_repair.repair(df.limit(0)).count() == 0


def test_very_long_text(spark):
    text = "word. " * 400_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    x = conversation_repair.repair(df).first()
    assert (x["audit"], x["repaired_sha256"]) == ("KK", hashlib.sha256(f"user:{text}\nassistant:{text}".encode()).hexdigest())
