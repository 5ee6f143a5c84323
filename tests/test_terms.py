"""Terms of texts in tasks, and vocabularies that are larger than a join broadcasts."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidence_engine.functions import text
from evidence_engine.operators import chunking, inverted, similarity
from evidence_engine.plans import queries, verify
from tests.texts import prose

ODD = [None, "", "a", "ab", "abc", "The the THE a-b $5 x$ -y- a--$b_c d-", "İstanbul ΑΣ ΟΔΟΣ. ǅ", "x" * 49 + "İab rest of it", "é🙂é🙂", "a\x00b\tc\nd", "Ünïcode " * 30, "KK m", "-$-", "tail " * 20 + "İ"]


def test_terms_in_tasks_are_those_of_columns(spark, monkeypatch):
    monkeypatch.setattr(text, "SLICE_CHARS", 40)
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, text string").coalesce(1)
    want = {r["id"]: sorted(r["terms"] or []) for r in df.select("id", text.terms(F.col("text")).alias("terms")).collect()}
    got = {}
    for batch in text.slices(df.select("id", *text.lowered(F.col("text"))).toArrow().to_batches()):
        terms, ids = text.batch_terms(batch), batch.column("id").to_pylist()
        for i in ids:
            got[i] = []
        for r, p in zip(terms.row, terms.place):
            got[ids[r]].append(terms.words[int(p)].as_py())
    assert {k: sorted(v) for k, v in got.items()} == want and sum(map(len, want.values())) > 300
    df_of = {r["term"]: r["df"] for r in similarity.document_frequencies(df).collect()}
    assert df_of == {t: sum(t in set(v) for v in want.values()) for v0 in want.values() for t in v0}
    found, n = similarity.counted_frequencies(df)
    assert n == len(ODD) and {r["term"]: r["df"] for r in found.collect()} == df_of


def test_texts_too_short_for_triples(spark):
    """One or two letters that are not all ASCII, among others."""
    rows = list(enumerate(["È.", "é", "É", "ß", "🙂", "🙂x", "Ñ1", "ab", "a", "", None, "È.x", "a longer text é"]))
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    want = {r["id"]: r["terms"] or [] for r in df.select("id", text.terms(F.col("text")).alias("terms")).collect()}
    found, n = similarity.counted_frequencies(df)
    assert n == len(rows) and {r["term"]: r["df"] for r in found.collect()} == {t: sum(t in v for v in want.values()) for x in want.values() for t in x}
    assert {r["id"] for r in similarity.text_norms(df, "id").collect()} == {i for i, v in want.items() if v}
    claims = spark.createDataFrame([(0, "È.x"), (1, "🙂"), (2, "ab é")], "claim long, text string")
    asked = {r["claim"]: set(r["terms"]) for r in claims.select("claim", text.terms(F.col("text")).alias("terms")).collect()}
    pairs = {(r["claim"], r["id"]) for r in similarity.all_cosines(claims, df, "claim", "id").collect()}
    assert pairs == {(a, i) for a, x in asked.items() for i, v in want.items() if x & set(v)} and len(pairs) > 2


def test_marks_that_are_the_same(monkeypatch):
    monkeypatch.setattr(inverted, "marks_of", lambda words: np.array([len(w) for w in words], np.uint64))
    known = inverted.Vocabulary(pa.array(["aa", "b", "cc", "dddd"]), np.arange(4.0))
    assert known.place(pa.array(["cc", "aa", "zz", "b", "x", "dddd", "yyyy", "y" * 9])).tolist() == [2, 0, -1, 1, -1, 3, -1, -1]


@pytest.fixture
def many_terms(spark, monkeypatch):
    """Texts with more terms than a join broadcasts; rows of one term are not to be moved for them."""
    monkeypatch.setattr(similarity, "BROADCAST_TERMS", 5)
    rows = [(i, i, f"f{i % 7}", f"{prose(i % 30, 6)} only{i} only{i} pair{i // 2}", 1.0) for i in range(60)] + [(60, 60, "f0", None, 1.0), (61, 61, "f0", "", 1.0)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_pos long, filename string, text string, authority_weight double").repartition(3)
    claims = spark.createDataFrame([("a", f"{prose(3, 9)} only7 unheard"), ("b", "pair4 only9 pair9"), ("c", "unheard"), ("d", None)], "claim_key string, text string")

    def vector(terms, idf):
        return {t: terms.count(t) * idf[t] for t in set(terms) if t in idf}

    docs, asked = ({r[0]: list(r[1] or []) for r in df.select(key, text.terms(F.col("text"))).collect()} for df, key in ((chunks, "doc_id"), (claims, "claim_key")))
    terms = {t for v in docs.values() for t in v}
    idf = {t: round(math.log((len(docs) + 1) / (sum(t in v for v in docs.values()) + 1)) + 1, 9) for t in terms}
    return chunks, claims, {k: vector(v, idf) for k, v in docs.items()}, {k: vector(v, idf) for k, v in asked.items()}


def moved(*args):
    raise AssertionError("a row for every term of a text")


def length(v):
    return math.sqrt(sum(x * x for x in v.values()))


@pytest.mark.parametrize("listed", [8_000_000, 3])
def test_cosines_and_norms_of_many_terms(spark, monkeypatch, many_terms, listed):
    """Also where more terms are known than a task can list."""
    chunks, claims, docs, asked = many_terms
    monkeypatch.setattr(similarity, "LISTED_TERMS", listed)
    if listed > 3:
        monkeypatch.setattr(similarity, "weights", moved)
    got = {(r[0], r[1]): r[2] for r in similarity.all_cosines(claims, chunks, "claim_key", "doc_id").collect()}
    want = {(a, d): sum(x * v[t] for t, x in w.items() if t in v) / (length(w) * length(v)) for a, w in asked.items() for d, v in docs.items() if set(w) & set(v)}
    assert got == pytest.approx(want, abs=1e-8) and len(want) > 50
    norms = {r["doc_id"]: r["norm"] for r in similarity.text_norms(chunks, "doc_id").collect()}
    assert norms == pytest.approx({d: length(v) for d, v in docs.items() if v}, abs=1e-6)


def test_cosines_are_rounded_once(spark, monkeypatch, many_terms, tmp_path):
    """What the query rounds to 4 digits has not been rounded to 9 before: 0.09545 to 9 digits can be 0.0954499999 to all."""
    chunks, claims, docs, asked = many_terms
    items = claims.select(F.ascii("claim_key").cast("long").alias("item_id"), "text")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    chunks.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    found, real = [], similarity.all_cosines
    monkeypatch.setattr(similarity, "all_cosines", lambda *a, **k: found.append(real(*a, **k)) or found[0])
    queries.tfidf_cosine(spark, str(tmp_path))
    got = {(chr(r[0]), r[1]): r[2] for r in found[0].collect()}
    want = {(a, d): sum(x * v[t] for t, x in w.items() if t in v) / (length(w) * length(v)) for a, w in asked.items() for d, v in docs.items() if set(w) & set(v)}
    assert got == pytest.approx(want, rel=0, abs=3e-10) and not all(round(x, 9) == x for x in got.values())


@pytest.mark.parametrize("listed", [8_000_000, 3])
def test_candidates_of_many_terms(spark, monkeypatch, many_terms, listed):
    chunks, claims, docs, asked = many_terms
    monkeypatch.setattr(similarity, "LISTED_TERMS", listed)
    if listed > 3:
        monkeypatch.setattr(similarity, "weights", moved)
    got = {(r["claim_key"], r["doc_id"]): r["similarity"] for r in verify.candidates(claims, chunks, verify.Config(threshold=0.2), chunk="doc_id").collect()}
    for (a, d), near in got.items():
        assert near == pytest.approx(sum(x * docs[d][t] for t, x in asked[a].items() if t in docs[d]) / (length(asked[a]) * length(docs[d])), abs=1e-8)
    assert {a for a, _ in got} == {"a", "b"} and ("b", 9) in got


def test_passages_leave_a_task_before_its_batch_is_read(spark, monkeypatch):
    """One batch of a hundred texts: the passages of a few at a time."""
    monkeypatch.setattr(text, "SLICE_CHARS", 1000)
    docs = spark.createDataFrame([(i, "A sentence of words. " * 20) for i in range(100)] + [(100, None)], "doc_id long, text string").coalesce(1)
    taken, real = {}, type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: taken.update(run=run, df=df) or real(df, run, schema))
    found = chunking.prose_chunks(docs, "doc_id")
    sizes = [len(set(x.column("doc_id").to_pylist())) for x in taken["run"](iter(taken["df"].toArrow().combine_chunks().to_batches()))]
    assert sum(sizes) == 100 and max(sizes) <= 3
    assert found.select("doc_id").distinct().count() == 100
