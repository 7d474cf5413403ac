"""The training-data operators against brute force, on small tables with nulls, empties, ties, copies and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from terravow.llm import decontaminate, exact_dedup, html_extract, langid, packing, quality, simhash_dedup, suffix_dedup, token_count, toxicity
from terravow.llm.shared import table

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, _run int, _fp long, keep_id long, length long"


def rows_of(texts, first=0):
    return [(first + i, t, "en", "s", len(t or ""), 1, 2, 3, 4) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    random.seed(11)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
    base = [" ".join(random.choices(words, k=random.randint(1, 180))) for _ in range(40)]
    near = [b.replace("alpha", "omega", 1) for b in base[:15]]
    shared = " ".join(random.choices(words, k=120))
    holds = [f"{b} {shared} {c}" for b, c in zip(base[:8], base[8:16], strict=True)]
    return [None, "", " ", "\t\n", "a", "A  b", "A b", "é ü", "aaaa" * 400, *base, *base[:10], *near, *holds, "The  Quick\tbrown", "The Quick brown", "x " * 3000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), EXTRA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EXTRA)


def test_exact_dedup(spark, docs, texts, nothing):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in enumerate(texts)}
    groups = collections.defaultdict(list)
    for i, n in norm.items():
        groups[n].append(i)
    found = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert len(found) == len(texts)
    for i, n in norm.items():
        r = found[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(groups[n]), len(groups[n]), i == min(groups[n]), hashlib.sha256(n.encode()).hexdigest())
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    found = exact_dedup.exact_dedup(df).collect()
    assert sorted((r["doc_id"] is None, r["kept"]) for r in found) == [(False, False), (False, True), (True, False), (True, True)]


def test_simhash(docs, texts, nothing):
    fps = [simhash_dedup.fingerprint((t or "").encode()) & (1 << 64) - 1 for t in texts]
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    found = {r["doc_id"]: r for r in simhash_dedup.simhash_components(docs).collect()}
    assert len(found) == len(texts)
    for i, fp in enumerate(fps):
        assert (found[i]["fingerprint"], found[i]["component_id"]) == (f"{fp:016x}", top(i))
    assert simhash_dedup.simhash_components(nothing).count() == 0


def test_golay_keys_meet_within_two_bits():
    golay, random_ = simhash_dedup.Golay(), np.random.default_rng(2)
    words = random_.integers(0, 1 << 23, 3000)
    for flips in (0, 1, 2):
        other = words.copy()
        for k in range(flips):
            other ^= 1 << ((words * 7 + 5 * k) % 23)
        a, b = golay.keys(words), golay.keys(other)
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b, strict=True))


def test_large_buckets_in_blocks(spark):
    keys = spark.createDataFrame([(5, i) for i in range(40)] + [(6, 1)], "_key long, _fp long")
    dealt = simhash_dedup._in_blocks(keys, [(5, 4)]).collect()
    together = collections.defaultdict(set)
    for r in dealt:
        together[r["_key"]].add(r["_fp"])
    pairs = {(a, b) for s in together.values() for a in s for b in s if a < b}
    assert {(a, b) for a in range(40) for b in range(a + 1, 40)} <= pairs and together[6] == {1}


def test_suffix_dedup(docs, texts, nothing):
    size = 400
    raw = [(t or "").encode() for t in texts]
    starts = collections.Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert len(found) == len(texts)
    for k, b in enumerate(raw):
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - size + 1):
            if starts[b[i : i + size]] > 1:
                gone[i + 1 : i + 1 + size] = True
        edges = np.flatnonzero(np.diff(gone.astype(int)) == 1), np.flatnonzero(np.diff(gone.astype(int)) == -1)
        assert [(s["start"], s["stop"]) for s in found[k]["spans"]] == list(zip(*(e.tolist() for e in edges), strict=True))
        assert bytes(found[k]["kept"]) == bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_anchors_do_not_depend_on_context():
    random.seed(4)
    core = bytes(random.choices(b"abcd ", k=700))
    place = []
    for before in (b"", b"zz" * 150, bytes(random.choices(b"xyz", k=333))):
        text = before + core + before[::-1]
        at, low, high = suffix_dedup.anchors(text)
        place.append([int(at[np.searchsorted(low, p + len(before), "right") - 1]) - len(before) for p in range(0, 300)])
        assert list(low[1:]) == list(high[:-1] + 1) and low[0] == 0 and high[-1] == len(text) - 400
    assert place[0] == place[1] == place[2]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("limit", [decontaminate.PHRASE_BYTES, 120])
def test_decontamination(spark, docs, texts, nothing, limit):
    items = [("7", texts[12]), ("8", "A! b"), ("9", None), ("10", "..."), ("11", texts[14][5:300]), ("7", texts[12])]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    windows = collections.defaultdict(set)
    for name, text in items:
        w = words(text)
        for i in range(len(w) - min(10, len(w)) + 1) if w else ():
            windows[tuple(w[i : i + min(10, len(w))])].add(name)
    found = {r["doc_id"]: r for r in decontaminate.contamination(docs, benchmark, phrase_bytes=limit).collect()}
    kept = {r["doc_id"] for r in decontaminate.uncontaminated(docs, benchmark).collect()}
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        w, hit, names = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (got := windows.get(tuple(w[i : i + size]))):
                    hit |= set(range(i, i + size))
                    names |= got
        spans = {p for s in found[k]["spans"] for p in range(s["start"], s["stop"])}
        assert (found[k]["n_words"], spans, set(found[k]["items"])) == (len(w), hit, names)
        assert (k in kept) == (not hit)
    assert decontaminate.contamination(nothing, benchmark).count() == 0
    assert not [r for r in decontaminate.contamination(docs, benchmark.limit(0)).collect() if r["spans"]]


@pytest.mark.parametrize("limit", [decontaminate.PHRASE_BYTES, 120])
def test_decontamination_reports_repeated_rows(spark, texts, limit):
    benchmark = spark.createDataFrame([("7", texts[12]), ("11", texts[14]), ("12", texts[16])], "item_id string, text string")
    docs = spark.createDataFrame(rows_of([texts[12]] * 3) + rows_of([texts[12], texts[12], texts[14], None]), EXTRA)
    docs = docs.unionByName(docs)
    found = collections.Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["spans"])), tuple(sorted(r["items"]))) for r in decontaminate.contamination(docs, benchmark, phrase_bytes=limit).collect())
    n, m = len(words(texts[12])), len(words(texts[14]))
    assert found == {(0, n, ((0, n),), ("7",)): 4, (1, n, ((0, n),), ("7",)): 4, (2, n, ((0, n),), ("7",)): 2, (2, m, ((0, m),), ("11",)): 2, (3, 0, (), ()): 2}


def test_fm_index_finds_and_locates():
    random_ = np.random.default_rng(1)
    sequence = np.concatenate([np.append(random_.integers(1, 4, 30), 0) for _ in range(6)]).astype("i8")
    index = decontaminate.FMIndex(sequence, 5)
    for size in (1, 2, 3, 5):
        patterns = random_.integers(1, 4, (20, size)).astype("i8")
        for p, low, high in zip(patterns, *index.search(patterns), strict=True):
            expected = [i for i in range(len(sequence) - size + 1) if (sequence[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(low, high)).tolist()) == expected


def test_token_counts(spark, docs, texts, nothing):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    odd = ["<s> </s>", "▁▁x ▁", "     " * 90, "日本語 한국어 😀", "a\0b\n\n", "1234567 http://x.y/?q=%20"]
    found = {r["doc_id"]: r for r in token_count.token_counts(docs.unionByName(spark.createDataFrame(rows_of(odd, 1000), EXTRA)), path).collect()}
    for k, text in [*enumerate(texts), *enumerate(odd, 1000)]:
        n = len(model.encode(text or ""))
        assert (found[k]["n_bytes"], found[k]["n_tokens"], found[k]["over_limit"]) == (len((text or "").encode()), n, n > 4096)
    assert token_count.token_counts(nothing, path).count() == 0


def test_long_texts_without_a_free_place(monkeypatch):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    transducer, model = token_count.compiled(path), SentencePieceProcessor(model_file=path)
    random.seed(6)
    texts = ["a" * 3_000_000, "ab" * 200_000, "".join(random.choices("ab", k=60_000)), "the " * 5000 + "e" * 90_000, "x", "étéét" * 20_000]
    expected = [len(model.encode(t)) for t in texts]
    assert transducer.counts([t.encode() for t in texts]).tolist() == expected
    monkeypatch.setattr(token_count, "STATES", 1)
    assert transducer.counts([t.encode() for t in texts[1:]]).tolist() == expected[1:]


def test_transducer_survives_forgetting():
    import public_tokenizers

    transducer = token_count.compiled(public_tokenizers.path("piece_bpe_32k.model"))
    text = [b"the transducer may forget " * 30]
    before = transducer.counts(text)
    transducer.forget()
    assert (transducer.counts(text) == before).all()


def test_transducer_outgrows_its_table(monkeypatch):
    import signal

    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(token_count, "TRANSITIONS", 64)
    transducer, model = token_count.Transducer(token_count.compiled(path).score), SentencePieceProcessor(model_file=path)
    random.seed(5)
    texts = ["".join(random.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=k)) for k in (3000, 40000)]

    def stop(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(60)
    try:
        found = [transducer.counts([t.encode()])[0] for t in texts]
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    assert found == [len(model.encode(t)) for t in texts]


def test_packing(spark, docs, texts, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["<|endoftext|> A <|STARTOFTEXT|>", "J̌ É. it's... x,y 3.5.", "a\x1cb  c", "'s ' ll we'll."]
    both = docs.unionByName(spark.createDataFrame(rows_of(odd, 1000), EXTRA))
    found = packing.best_fit_packing(both, path, capacity=64).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
    for k, text in [*enumerate(texts), *enumerate(odd, 1000)]:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = [ids[i : i + 64] for i in range(0, len(ids), 64)]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in sorted(by[k], key=lambda r: r["piece"])] == [(n, 64 * n, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for n, p in enumerate(pieces)]
    for group in collections.defaultdict(list, {s: [r for r in found if r["sequence_id"] == s] for s in {r["sequence_id"] for r in found}}).values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.best_fit_packing(nothing, path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plans(seed):
    random.seed(seed)
    capacity = random.choice([10, 50, 300])
    count = collections.Counter(random.randint(1, capacity) for _ in range(random.choice([1, 12, 400])))
    plan = packing.pack_lengths(count, capacity)
    used = collections.Counter()
    for content, n in plan:
        assert sum(content) <= capacity
        for size in content:
            used[size] += n
    assert used == count
    least = -(-sum(k * n for k, n in count.items()) // capacity)
    assert sum(n for _, n in plan) <= 11 * least // 9 + 6 + sum(n for k, n in count.items() if 2 * k > capacity)


def test_learned_operators(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    mark = {r["doc_id"]: r for r in labels.collect()}
    scores = quality.quality_scores(docs, labels).collect()
    held = [r for r in scores if r["held_out"] and r["doc_id"] in mark]
    assert np.mean([r["predicted"] == mark[r["doc_id"]]["quality"] for r in held]) > 0.85
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] and 0 <= r["score"] <= 1 for r in scores)
    toxic = toxicity.toxicity_scores(docs, labels).collect()
    assert len(toxic) == docs.count() and all(0 <= r["score"] <= 1 for r in toxic)
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = [r for r in langid.language_labels(docs).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in found]) > 0.85


def test_learned_operators_on_odd_rows(spark, docs, nothing, texts):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for found in (quality.quality_scores(docs, labels), toxicity.toxicity_scores(docs, labels)):
        assert found.count() == len(texts)
    assert quality.quality_scores(nothing, labels.limit(0)).count() == 0
    assert toxicity.toxicity_scores(nothing, labels.limit(0)).count() == 0
    found = {r["doc_id"]: r["lang_pred"] for r in langid.language_labels(docs).collect()}
    assert found[0] == found[1] == found[3] == "und" and found[4] == "en"
    assert langid.language_labels(nothing).count() == 0


def test_language_sample_is_ranked_within_bounds(spark):
    rows = [(k, "der die das und " * 4 if k % 5 else "the and of to " * 4, "de" if k % 5 else "en") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.language_labels(docs, per_lang=40).collect()
    assert np.mean([(r["lang_pred"] == "de") == (r["doc_id"] % 5 > 0) for r in found]) > 0.95
    assert sorted(found) == sorted(langid.language_labels(docs.repartition(7), per_lang=40).collect())


def test_pooled_probabilities_do_not_depend_on_neighbours():
    random.seed(9)
    net = langid.train(np.frombuffer(random.randbytes(64 * 40), "u1").reshape(-1, 64) % 90 + 32, np.arange(40) % 3, 3)
    texts = [random.randbytes(k) for k in (1, 5, 63, 64, 65, 200, 1000, 3)]
    together = langid.document_probabilities(net, texts)
    assert np.allclose(together, [langid.document_probabilities(net, [t])[0] for t in texts], atol=1e-6)
    assert np.allclose(together.sum(axis=1), 1, atol=1e-5)


def test_gru_gradients():
    random_ = np.random.default_rng(0)
    d = langid.Direction(*(random_.normal(size=s).astype("f8") * 0.4 for s in ((256, 9), (3, 6), (3, 3))))
    steps, weight = random_.integers(0, 256, (5, 2)), random_.normal(size=(5, 2, 3))
    loss = lambda: float((d.run(steps).astype("f8") * weight).sum())
    _, kept = d.run(steps, keep=True)
    for parameter, gradient in zip((d.table, d.gates, d.inner), d.back(steps, kept, weight), strict=True):
        place = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        old, eps = parameter[place], 1e-3
        parameter[place] = old + eps
        up = loss()
        parameter[place] = old - eps
        down = loss()
        parameter[place] = old
        assert abs((up - down) / (2 * eps) - gradient[place]) < 2e-2 * max(1, abs(gradient[place]))


PAGE = """<!doctype html><html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies to make this site better for you, please accept them.</p></div><article><h1>A  title</h1><p>First &amp; foremost,
a paragraph.<br>And more.<div class="ad-box">Buy this product today, it is the best.</div><p><b>Second<p>Third.</article>
<section class="comments"><p>I am a reader and I like this very much, thank you.</p></section><aside>Side text that is long enough to look like prose.</aside><form><p>Name of the sender, please.</p></form><footer>&copy; x</footer>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (1, "u", PAGE), (4, "w", "<p>" + "word " * 50000)], "page_id long, url string, html string")
    found = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_pages(pages).collect())
    text = "A title\nFirst & foremost, a paragraph. And more.\nSecond\nThird."
    assert found[:2] == [(1, text, len(text))] * 2 and found[2][1:] == found[3][1:] == ("", 0)
    assert found[4][2] == 50000 * 5 - 1


@pytest.mark.parametrize("seed", range(8))
def test_minimum_cut_is_minimal(seed):
    random.seed(seed)
    n = 9
    unary = [random.uniform(-2, 2) for _ in range(n)]
    edges = [(i, j, random.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if random.random() < 0.4]
    cost = lambda x: sum(max(0, -u) if k else max(0, u) for u, k in zip(unary, x, strict=True)) + sum(c for i, j, c in edges if x[i] != x[j])
    best = min(cost([m >> i & 1 == 1 for i in range(n)]) for m in range(1 << n))
    assert abs(cost(html_extract.minimum_cut(unary, edges)) - best) < 1e-9


@pytest.mark.parametrize("depth", [3, 198, 199, 10000])
def test_html_closes_across_any_depth(depth):
    article = "<article><p>The first paragraph of the article is long enough to be kept.</p><p>So is the second one, which follows.</p></article>"
    blocks, leans = html_extract.blocks_of("<nav>" + "<b>" * depth + "Menu</nav>" + article)
    assert [b.text[:9] for b in blocks] == ["Menu", "The first", "So is the"]
    assert [len(b.chain) for b in blocks] == [1, 2, 2]


def test_html_blocks_by_their_surroundings():
    """Blocks whose own text speaks for the other label."""
    prose = "This is a sentence of prose that by itself looks like an article, and it is long."
    page = f"<article><p>{prose}</p><div>Three</div><p><a href=x>Only a link</a></p><p>{prose}</p></article><section class=comments><div><p>{prose}</p><p>{prose}</p></div></section>"
    blocks, leans = html_extract.blocks_of(page)
    labels = html_extract.minimum_cut(*html_extract.graph_of(blocks, leans))[: len(blocks)]
    assert labels == [True] * 4 + [False] * 2
    assert [b.score > 0 for b in blocks] == [True, False, False, True, True, True]


def test_html_labels_are_minimal_on_small_pages():
    pages = ["<nav><a>x</a></nav><div><p>One two three.</p><p>y</p></div>", "<div><p>Some words here, yes.</p><div class=share><p>Share this.</p></div></div>", "<main><h1>T</h1><form><p>Your name, please.</p></form>end</main>"]
    for page in pages:
        unary, edges = html_extract.graph_of(*html_extract.blocks_of(page))
        cost = lambda x: sum(max(0, -u) if k else max(0, u) for u, k in zip(unary, x, strict=True)) + sum(c for i, j, c in edges if x[i] != x[j])  # noqa: B023, E731
        best = min(cost([m >> i & 1 == 1 for i in range(len(unary))]) for m in range(1 << len(unary)))
        assert abs(cost(html_extract.minimum_cut(unary, edges)) - best) < 1e-9


def test_html_keeps_all_of_the_article():
    page = "<article><p>Let <math><mi>x</mi></math> be given, and <svg><text>y</text></svg> too.</p><object>z</object><form><button>Send</button><select><option>a</option></select></form></article>"
    assert html_extract.main_text(page) == "Let x be given, and y too.\nz"


def test_html_long_mixed_page():
    page = "<div>" + "".join(f"<p>{'A sentence with some words, number %d.' % k if k % 3 else '<a href=x>link</a>'}</p>" for k in range(10000)) + "</div>"
    assert html_extract.main_text(page).count("\n") >= 6000
