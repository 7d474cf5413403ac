"""Very long texts, repeated rows, null and repeated ids and clashing names, for the operators that learn and those around them."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from terravow.llm import html_extract, langid, packing, quality, simhash_dedup, suffix_dedup, toxicity
from terravow.llm.shared import table, written

CLASHING = ["_id", "_text", "_label", "score", "held_out", "predicted", "lang_pred", "_part", "features", "_fp", "_rep", "fingerprint", "piece", "start", "length", "sequence_id", "offset", "html", "n_chars2", "text2"]


@pytest.fixture(scope="module")
def odd(spark, small):
    """The table's documents, with odd ones behind, and the same with clashing columns."""
    plain = table(spark, small, "documents").select("doc_id", "text", "lang")
    long = plain.where("length(text) > 200").orderBy("doc_id").first()["text"]
    rows = [(5000, (long + " ") * (3_000_000 // len(long)), None), (5001, long, None), (5001, long, None), (None, long, None), (None, None, None), (5002, "", None), (5003, " \t", None)]
    docs = written(plain.unionByName(spark.createDataFrame(rows, plain.schema)), "odd")
    clashing = docs
    for k, name in enumerate(CLASHING):
        clashing = clashing.withColumn(name, F.lit(k))
    return docs, written(clashing, "clashing")


def same(a, b, *columns):
    rows = [sorted(map(str, (tuple(r) for r in x.select(*columns).collect()))) for x in (a, b)]
    assert rows[0] == rows[1] and rows[0]


@pytest.mark.parametrize(("score", "column"), [(quality.quality_scores, "score"), (toxicity.toxicity_scores, "score"), (lambda docs, _: langid.language_labels(docs), "lang_pred")])
def test_learned_scores_follow_the_text_alone(spark, small, odd, score, column):
    labels = table(spark, small, "labels")
    docs, clashing = odd
    found = written(score(docs, labels), "scores")
    assert found.count() == docs.count()
    of = collections.defaultdict(set)
    for r in found.where("doc_id IS NULL OR doc_id >= 5000").collect():
        of[r["doc_id"]].add(r[column])
    assert len(of[5001]) == 1 and of[5001] <= of[None] and of[5002] == of[5003] <= of[None]
    same(found, score(clashing, labels), "doc_id", "held_out", column)


def test_toxicity_of_held_out_documents(spark):
    """Accuracy and ranking where no label was seen."""
    d = "/root/testdata/sf0.01"
    mark = {r["doc_id"]: r["toxic"] for r in table(spark, d, "labels").where("toxic IS NOT NULL").collect()}
    held = [(r["score"], r["predicted"], mark[r["doc_id"]]) for r in toxicity.op8_toxicity(spark, d).collect() if r["held_out"] and r["doc_id"] in mark]
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 or i in mark for i in mark) and len(held) > 60
    bad, good = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([p == y for _, p, y in held]) > 0.85
    assert np.mean([(a > b) + (a == b) / 2 for a in bad for b in good]) > 0.85


def test_fingerprints_of_odd_rows(odd):
    docs, clashing = odd
    found = written(simhash_dedup.simhash_components(docs), "near")
    own = {(r["doc_id"], r["fingerprint"]) for r in found.collect()}
    assert found.count() == docs.count() and len({f for i, f in own if i in (5002, 5003)}) == 1
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id >= 5000").collect()}
    for i in (5000, 5001):
        assert (i, f"{simhash_dedup.fingerprint(texts[i].encode()):016x}") in own
    same(found, simhash_dedup.simhash_components(clashing), "doc_id", "fingerprint", "component_id")


def test_packing_of_odd_rows(odd):
    docs, clashing = odd
    path = public_tokenizers.path("word_bpe_49k.json")
    found = [r for r in packing.best_fit_packing(docs, path).collect()]
    places = collections.defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and own[-1][0] + own[-1][1] <= 2048
    assert sum(1 for r in found if r["doc_id"] == 5001 and r["piece"] == 0) == 2  # repeated rows are packed each
    assert sum(1 for r in found if r["doc_id"] is None and r["piece"] == 0) == 2
    assert max(r["piece"] for r in found if r["doc_id"] == 5000) > 100
    assert sum(r["length"] for r in found) == sum(r["length"] for r in packing.best_fit_packing(clashing, path).collect())


def test_pages_with_clashing_names(spark, small):
    pages = table(spark, small, "pages")
    rows = pages
    for k, name in enumerate(["text", "n_chars", "html2", "lang"]):
        rows = rows.withColumn(name, F.lit(k))
    long = "<article>" + "<p>A paragraph of prose, with a comma and an end.</p>" * 40_000 + "</article>"
    rows = rows.select("page_id", "url", "html", "text", "n_chars")
    extra = spark.createDataFrame([(1, None, None, 0, 0), (None, "u", long, 0, 0), (1, None, None, 0, 0)], rows.schema)
    same(html_extract.extract_pages(pages), html_extract.extract_pages(rows), "page_id", "url", "text", "n_chars")
    found = html_extract.extract_pages(extra).collect()
    assert sorted((r["page_id"] is None, r["n_chars"]) for r in found) == [(False, 0), (False, 0), (True, 40_000 * 47 - 1)]


def test_many_copies_of_one_id(spark):
    """Repeated rows are documents of their own; their number does not multiply the work."""
    draw = random.Random(1)
    text = " ".join(draw.choices(["alpha", "beta", "gamma", "delta"], k=400))
    for ident in (7, None):
        docs = spark.createDataFrame([(ident, text)] * 3000 + [(9, text[:300])], "doc_id long, text string").repartition(4)
        found = suffix_dedup.remove_repeats(docs).selectExpr("doc_id <=> 9 AS other", "length(kept) AS kept", "size(spans) AS spans").groupBy("other", "kept", "spans").count().collect()
        assert sorted(tuple(r) for r in found) == [(False, 0, 1, 3000), (True, 300, 0, 1)]
