"""Keyword search and pruned products of sparse vectors against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from evidence_engine.operators import evaluation, inverted, keywords, retrieval, similarity
from evidence_engine.plans import verify
from tests.texts import prose


def places(text, keyword):
    return [i for i in range(len(text) - len(keyword) + 1) if text.startswith(keyword, i)]


@pytest.mark.parametrize("block", [5, 1_000_000])
def test_occurrences(spark, monkeypatch, block):
    monkeypatch.setattr(keywords, "BLOCK_CHARS", block)
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("abé🙂 ") for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(80, None), (81, "")]
    wanted = ["a", "ab", "aba", "bab", "é🙂", "a b", "zz", " ", "abababab"]
    got = keywords.occurrences(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(k,) for k in wanted + ["a", "", None]], "keyword string"), "id")
    want = {(i, k, len(p), p[0]) for i, t in texts for k in wanted if (p := places(t or "", k))}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 200
    found = keywords.present(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(k,) for k in wanted], "keyword string"))
    assert sorted(r[0] for r in found.collect()) == sorted({k for _, k, _, _ in want})


def test_no_keywords_and_no_texts(spark):
    none, some = spark.createDataFrame([], "id long, text string"), spark.createDataFrame([(1, "abc")], "id long, text string")
    asked, nothing = spark.createDataFrame([("b",)], "keyword string"), spark.createDataFrame([], "keyword string")
    assert keywords.occurrences(some, nothing, "id").count() == 0 and keywords.present(some, nothing).count() == 0
    assert keywords.occurrences(none, asked, "id").count() == 0 and keywords.present(none, asked).count() == 0


def test_hits_anywhere(spark):
    cases = spark.createDataFrame([(1, ["RIVER stone"]), (2, ["nowhere", "é🙂"]), (3, []), (4, ["nowhere"]), (5, [""]), (6, ["one two three four five six"])], "id long, keywords array<string>")
    texts = spark.createDataFrame([("a River Stone.",), (None,), ("xÉ🙂",), ("zero one two three four five six seven",)], "text string")
    assert sorted(tuple(r) for r in evaluation.hits_anywhere(cases, texts, "id").collect()) == [(1, True), (2, True), (4, False), (5, True), (6, True)]
    assert sorted(tuple(r) for r in evaluation.hits_anywhere(cases, texts.limit(0), "id").collect()) == [(1, False), (2, False), (4, False), (5, False), (6, False)]


def lists(rng, n, vocabulary):
    return [[rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 15]))] for _ in range(n)]


def test_segment_against_all_products():
    """At every bound exactly the pairs that reach it."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(25)]
    known = inverted.Vocabulary(pa.array(words), np.round(np.array([1 + rng.random() * (1 + i / 4) for i in range(25)]), 9))
    for cells in (40, 2_000_000):
        inverted.CELLS = cells
        for trial in range(20):
            passages, asked = lists(rng, 30, [*words, "strange"]), lists(rng, 12, [*words[:18], "unknown"])
            vector = lambda ws: np.array([ws.count(w) for w in words]) * known.idf
            unit = lambda v: v / (np.linalg.norm(v) or 1)
            want = np.array([[unit(vector(p)) @ unit(vector(a)) for a in asked] for p in passages])
            bound = np.array([rng.choice([-np.inf, 0, 0.2, 0.5, 0.9]) for _ in asked])
            row, claim, near = inverted.Segment(pa.array(passages, pa.list_(pa.string())), known, inverted.Claims(asked, known)).reaching(bound)
            assert np.allclose(near, want[row, claim], atol=1e-8) and len(set(zip(row, claim))) == len(row)
            sure, never = want > np.maximum(bound, 0) + 1e-6, want < np.maximum(bound, 1e-6) - 1e-6
            got = np.zeros_like(sure)
            got[row, claim] = True
            assert got[sure].all() and not got[never].any()


def test_pruning_reads_less_than_all_products(monkeypatch):
    """With a threshold only the lists that can lead there are read."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    known = inverted.Vocabulary(pa.array(words), np.array([1.0] * 3 + [6.0] * 397))
    passages = [[*(rng.choice(words[:3]) for _ in range(10)), rng.choice(words)] for _ in range(500)]
    read = []
    plain = inverted.expanded
    monkeypatch.setattr(inverted, "expanded", lambda first, of: (lambda out: read.append(len(out[0])) or out)(plain(first, of)))
    asked = inverted.Claims([["w0", "w1", "w2", "w50", "w51", "w52"]], known)
    segment = inverted.Segment(pa.array(passages), known, asked)
    segment.reaching(np.zeros(1))
    every = read[0]
    read.clear()
    segment.reaching(np.array([0.7]))
    assert read[0] < every / 20


@pytest.mark.parametrize("seed,threshold,weighted,terms", [(1, 0.25, True, 500_000), (2, 0.6, True, 500_000), (3, 0.95, False, 500_000), (4, 0.4, True, 10)])
def test_candidates_lead_to_the_evidence_of_all_pairs(spark, monkeypatch, seed, threshold, weighted, terms):
    monkeypatch.setattr(similarity, "BROADCAST_TERMS", terms)
    monkeypatch.setattr(verify, "CELLS", 50)
    rng = random.Random(seed)
    rows = [(i, i, f"f{rng.randint(0, 6)}", prose(rng.randint(0, 60), rng.choice([0, 3, 12])), rng.choice([1.0, 0.97, 0.9, 0.5])) for i in range(150)]
    chunks = spark.createDataFrame(rows, "chunk_key int, chunk_pos int, filename string, text string, authority_weight double").repartition(3)
    claims = spark.createDataFrame([(str(i), prose(rng.randint(0, 80), 8)) for i in range(12)] + [("q", "quixotic"), ("e", "")], "claim_key string, text string")
    config = verify.Config(threshold=threshold, authority_weighting=weighted)
    slow = verify.sparse_pairs(claims, chunks.select("chunk_key", "text")).join(chunks.drop("text"), "chunk_key")
    pick = lambda df: {(r["claim_key"], r["chunk_key"], r["evidence_rank"], r["similarity"]) for r in retrieval.retrieve(df, 3, threshold, ["claim_key"], weighted=weighted).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        assert pick(verify.candidates(claims, chunks, config)) == pick(slow)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_all_cosines(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i % 20, 9)) for i in range(50)] + [(50, None), (51, "")], "doc_id long, text string")
    items = spark.createDataFrame([(f"i{i}", prose(i, 6)) for i in range(7)] + [("none", None)], "item_id string, text string")
    got = {tuple(r) for r in similarity.all_cosines(items, docs, "item_id", "doc_id").collect()}
    monkeypatch.setattr(similarity, "BROADCAST_TERMS", 5)
    want = {tuple(r) for r in similarity.all_cosines(items, docs, "item_id", "doc_id").collect()}
    assert {k[:2] for k in got} == {k[:2] for k in want} and len(got) > 200
    near = {k[:2]: k[2] for k in want}
    assert all(abs(near[k[:2]] - k[2]) < 1e-8 for k in got)
