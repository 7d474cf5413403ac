"""The pipeline's stages, each on all that its predecessor kept, against brute force written apart from the operators."""

import collections
import re

import corpus_pipeline
import pytest
import xxhash
from pyspark.sql import functions as F
from terravow.llm import quality
from terravow.llm.shared import table, written

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))


def space(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups_of(rows):
    """Indices of the rows of each group of linked fingerprints."""
    found, root = [fingerprint(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (found[i] ^ found[j]).bit_count() <= 4:
                root[max(top(i), top(j))] = min(top(i), top(j))
    grouped = collections.defaultdict(list)
    for i in range(len(rows)):
        grouped[top(i)].append(rows[i])
    return list(grouped.values())


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages(spark, small):
    docs = written(table(spark, small, "documents"), "docs")
    items = [words(r["text"]) for r in table(spark, small, "benchmark").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in items if w for i in range(len(w) - min(10, len(w)) + 1)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows_of(docs)
        out = written(stage(spark, docs, small), name)
        after = rows_of(out)
        assert out.columns == docs.columns and after
        if name == "quality":
            assert [i for i, _ in after] == sorted(r["doc_id"] for r in quality.quality_scores(docs, table(spark, small, "labels")).where("predicted = 1").collect())
        elif name == "exact_dedup":
            first = {}
            for i, t in before:
                first.setdefault(space(t), (i, t))
            assert after == sorted(first.values(), key=lambda x: x[0])
        elif name == "near_dedup":
            assert after == sorted(min(g) for g in groups_of(before))
        else:
            hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
            assert after == [x for x in before if not hit(x[1])]
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert sorted({r["doc_id"] for r in packed.select("doc_id").collect()}) == [i for i, _ in rows_of(docs)]


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SHAPE)


def test_rows_that_repeat_an_id(spark, small):
    docs = made(spark, [(1, "a"), (2, "b"), (2, "a")])
    assert rows_of(corpus_pipeline.exact_stage(spark, docs, small)) == rows_of(corpus_pipeline.near_stage(spark, docs, small)) == [(1, "a"), (2, "b")]
    docs = made(spark, [(1, "a b"), (1, "a b"), (1, "a  b"), (None, None), (None, "a b"), (None, "c d"), (2, "a  b"), (None, "c d")])
    exact = written(corpus_pipeline.exact_stage(spark, docs, small), "exact")
    assert sorted((r["doc_id"] or 0, space(r["text"])) for r in exact.collect()) == [(0, ""), (0, "c d"), (1, "a b")]
    assert sorted((r["doc_id"] or 0, space(r["text"])) for r in corpus_pipeline.near_stage(spark, docs, small).collect()) == [(0, ""), (0, "c d"), (1, "a b")]


@pytest.mark.parametrize("rows", [[(7, "one two three four five six " * 30 + str(k)) for k in range(6)], [(7, "same text"), (7, "same text")]])
def test_near_rows_of_one_id_leave_one(spark, small, rows):
    kept = rows_of(corpus_pipeline.near_stage(spark, made(spark, rows), small))
    assert len(kept) == len(groups_of(rows)) and set(kept) <= set(rows)


def test_empty_tables(spark, small):
    nothing = made(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, nothing, small)
        assert out.count() == 0
        assert name == "packing" or out.columns == nothing.columns


def test_names_that_clash(spark, small):
    """Columns of the caller's with the names that the stages use for themselves."""
    extra = ["_keep", "_key", "_own", "_many", "_nth", "_first", "_row", "_id", "_text", "root", "fingerprint", "text_key", "kept", "text_sha256", "component_id", "label"]
    docs = table(spark, small, "documents").limit(120)
    odd = docs
    for k, name in enumerate(extra):
        odd = odd.withColumn(name, F.lit(k))
    odd, docs = written(odd, "odd"), written(docs, "docs")
    for name, stage in corpus_pipeline.STAGES:
        plain, other = stage(spark, docs, small), stage(spark, odd, small)
        if name == "packing":
            assert other.count() == plain.count()
        else:
            docs, odd = written(plain, name), written(other, name)
            assert rows_of(odd) == rows_of(docs) and odd.columns == [*docs.columns, *extra]
            assert [r[len(docs.columns) :] for r in odd.limit(3).collect()] == [tuple(range(len(extra)))] * min(3, odd.count())


def test_very_long_and_odd_texts(spark, small):
    rows = [(1, "word " * 300_000), (2, "word " * 300_000), (3, None), (4, ""), (5, "x" * 1_000_000), (None, "word " * 300_000)]
    docs = written(made(spark, rows), "docs")
    docs = written(corpus_pipeline.exact_stage(spark, docs, small), "exact")
    assert [i for i, _ in rows_of(docs)] == [1, 3, 5]
    near = rows_of(corpus_pipeline.near_stage(spark, docs, small))
    assert len(near) == len(groups_of(rows_of(docs))) and set(near) <= set(rows_of(docs))
