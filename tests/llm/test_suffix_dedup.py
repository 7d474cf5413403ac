"""Repeated byte strings: with sieves, with joins instead of them, and by prefix doubling, against brute force."""

import collections
import random

import pytest

from terravow.llm import suffix_dedup

SIZE = 400


def brute(raw, size=SIZE):
    starts = collections.Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    found = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            if starts[b[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        found.append(bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return found


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    words = ["alpha", "βήτα", "gamma", "дельта", "epsilon", "ζ", "theta", "iota"]
    text = lambda n: " ".join(draw.choices(words, k=n))
    shared, long = text(90), text(3000)
    texts = [text(draw.randint(1, 160)) for _ in range(20)] + [f"{text(20)} {shared} {text(30)}" for _ in range(12)]
    texts += [f"{text(3)} {shared[:k]}" for k in (200, 395, 401, 402, 408, 430)] + [long + shared, text(700) + long[5000:9000], "ab" * 900, "", None, shared]
    edited = [t.replace("gamma", "omega", 1) for t in texts[:8]]
    rows = list(enumerate(texts + edited + texts[:5]))
    return [*rows, (None, texts[3]), (None, texts[33]), (7, texts[9]), (7, texts[33]), (7, texts[33])]


@pytest.mark.parametrize("map_bits", [suffix_dedup.MAP_BITS, 0])
def test_repeats_leave_whole(spark, rows, map_bits):
    """Null and repeated ids, repeated rows, multi-byte characters; a bound of nothing takes the joins."""
    docs = spark.createDataFrame([(i, t, b"x", 1) for i, t in rows], "doc_id long, text string, _doc binary, rank long").repartition(3)
    found = suffix_dedup.remove_repeats(docs, map_bits=map_bits).collect()
    kept = brute([(t or "").encode() for _, t in rows])
    order = lambda xs: sorted(xs, key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))
    expected = [(i, len((t or "").encode()), k) for (i, t), k in zip(rows, kept, strict=True)]
    assert order((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in found) == order(expected)
    assert any(len(k) < n for _, n, k in expected)


def test_texts_taken_together(monkeypatch):
    """Anchors do not depend on which texts are hashed together; those of words say where the words are."""
    draw = random.Random(5)
    texts = [" ".join("".join(draw.choices("abé", k=draw.randint(1, 3))) for _ in range(draw.randint(0, 400))) + draw.choice(["", "\n\n x\t", " "]) for _ in range(60)]
    raw = [t.encode() for t in texts] + [b"", b"a" * 399, b"a" * 400, b" \n" * 300, b"a " * 51, b"a " * 50, b"q" * 70000]
    together = suffix_dedup.anchors_of(raw), suffix_dedup.word_windows(raw, 51, 16)
    for text, of_bytes, of_words in zip(raw, *together, strict=True):
        assert [x.tolist() for x in of_bytes] == [x.tolist() for x in suffix_dedup.anchors(text)]
        words = text.split()
        assert (of_words is None) == (len(words) < 51)
        if of_words is not None:
            view, first, (at, low, high) = of_words
            assert [bytes(view[a : b - 1]) for a, b in zip(first.tolist(), first.tolist()[1:])] == words
            windows = [(k, a) for a, b, c in zip(at.tolist(), low.tolist(), high.tolist(), strict=True) for k in range(b, c + 1)]
            assert [k for k, _ in windows] == list(range(len(words) - 50)) and all(k <= a <= k + 35 for k, a in windows)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 1)
    for one, other in zip(together[1], suffix_dedup.word_windows(raw, 51, 16), strict=True):
        assert (one is None) == (other is None)
        assert one is None or [x.tolist() for x in one[2]] == [x.tolist() for x in other[2]]


def sharing(texts, words=suffix_dedup.WORDS):
    """Whether each text holds ``words`` consecutive words of another one."""
    split = [(t or "").encode().split() for t in texts]
    own = [{tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)} for ws in split]
    held = collections.Counter(w for o in own for w in o)
    return [any(held[w] > 1 for w in o) for o in own]


@pytest.mark.parametrize("map_bits", [suffix_dedup.MAP_BITS, 0])
def test_shared_passages(spark, rows, map_bits):
    """Passages of 50 and 51 words, with other blanks between; what repeats in one document only is not shared."""
    draw = random.Random(3)
    text = lambda n: " ".join("".join(draw.choices("abcdeé", k=draw.randint(1, 4))) for _ in range(n))
    passages, twice = [text(51).split() for _ in range(9)], text(70)
    texts = [f"{text(draw.randint(0, 200))} {' '.join(p[:n])}\n{text(draw.randint(0, 90))}" for p in passages for n in (51, 50)]
    texts += [f"{text(40)}\t{(' ' * k).join(p)} {text(k)}" for k, p in enumerate(passages[:6], 1)]
    texts += [f"{twice} {text(9)} {twice}", text(5000), f"{text(60)} {' '.join(passages[8][:50])}", text(51), "x" * 9000, f"{text(99)} {' '.join(passages[0])} {twice[:90]}"]
    all_rows = [*rows, *((k + 1000, t) for k, t in enumerate(texts))]
    expected = sharing([t for _, t in all_rows])
    assert 8 < sum(expected[len(rows) :]) < len(texts) - 8
    docs = spark.createDataFrame([(i, t, True) for i, t in all_rows], "doc_id long, text string, _shares boolean").repartition(3)
    found = suffix_dedup.remove_repeats(docs, map_bits=map_bits).select("doc_id", "shares_passage").collect()
    order = lambda xs: sorted(xs, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert order((r[0], r[1]) for r in found) == order((i, e) for (i, _), e in zip(all_rows, expected, strict=True))


def test_doubling_finds_the_same(spark, rows):
    short = [(i, t) for i, t in rows if len(t or "") < 2500]
    docs = spark.createDataFrame(short, "doc_id long, text string").repartition(2)
    raw = [(t or "").encode() for _, t in short]
    spans = collections.defaultdict(set)
    for r in suffix_dedup.doubled_spans(docs).collect():
        spans[r["doc_id"], r["_row"]] |= set(range(r["start"], r["stop"]))
    lost = sorted((i is not None, i or 0, len(b) - len(k)) for (i, _), b, k in zip(short, raw, brute(raw), strict=True) if len(k) < len(b))
    assert sorted((i is not None, i or 0, len(x)) for (i, _), x in spans.items()) == lost


def test_empty_table(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(nothing).count() == suffix_dedup.remove_repeats(nothing, map_bits=0).count() == 0
    assert suffix_dedup.doubled_spans(nothing).count() == 0
