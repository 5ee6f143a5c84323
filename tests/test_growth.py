"""Work that must not grow faster than its tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_engine.operators import claims, retrieval, similarity
from evidence_engine.plans import queries
from evidence_engine.sources import ingest

PARTS = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def test_parts_alike_are_compared_once(spark, tmp_path):
    """A thousand parts of one brand in six kinds: 36 comparisons for 20,000 pairs; parts without a size or a brand as in SQL."""
    rows = [(i, "n", "b", "SMALL STEEL", 3 + i % 2, 1.0) for i in range(1000)] + [(1000, "n", "b", None, None, 1.0), (1001, "n", None, "SMALL STEEL", 3, 1.0)]
    spark.createDataFrame(rows, PARTS).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(a, b):
        calls.add(1)
        return f"{a[0].value}{a[0].bound} {b[0].value}{b[0].bound}"

    got = queries._parts(spark, str(tmp_path), told=seen(F.col("q"), F.col("other_q"))).collect()
    bound = lambda k: ("AT_MOST", "AT_LEAST", "EXACT")[k % 3]
    size = lambda k: float(3 + k % 2) if k < 1000 else None
    asked = [k for k in range(1001) if k % 50 == 0]
    assert {(r["p_partkey"], r["other_key"], r["told"]) for r in got} == {(a, b, f"{size(a)}{bound(a)} {size(b)}{bound(b)}") for a in asked for b in range(1001)}
    assert len(got) == 1001 * len(asked)
    assert calls.value <= 49


@pytest.mark.parametrize("listed", [True, False])
def test_pairs_of_parts_are_made_last_and_by_all_tasks(spark, tmp_path, monkeypatch, listed):
    """Kinds of several lists, with lists that are broadcast or joined; 40 kinds of two brands are dealt to many tasks."""
    rows = [(i, "n", f"b{i % 2}", f"{'SMALL' if i % 5 else 'LARGE'} STEEL", None if i % 97 == 0 else i % 4, 1.0) for i in range(900)] + [(950, "n", None, None, 1, 1.0)]
    spark.createDataFrame(rows, PARTS).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(queries, "LIST_KEYS", 10, raising=False)
    if not listed:
        monkeypatch.setattr(queries, "LISTED_KEYS", 0, raising=False)
        monkeypatch.setattr(similarity, "BROADCAST_TERMS", 0)
    same = F.struct(F.col("q")[0]["value"], F.col("q")[0]["context"], F.col("other_q")[0]["value"], F.col("other_q")[0]["context"])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = queries._parts(spark, str(tmp_path), told=same)
        tasks = found.select("p_partkey", "other_key", F.spark_partition_id().alias("task"), "told").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    said = lambda i: (None if rows[i][4] is None else float(rows[i][4]), [rows[i][2], rows[i][3].split()[0], "item"])
    got = sorted((r["p_partkey"], r["other_key"], repr(tuple(r["told"]))) for r in tasks)
    assert got == sorted((a, b, repr((*said(a), *said(b)))) for a in range(0, 900, 50) for b in range(900) if rows[a][2] == rows[b][2])
    if listed:
        assert len({r["task"] for r in tasks}) == 16


def test_only_pairs_that_retrieval_can_choose_leave_a_task(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"file_{i % 3}", [float(x) for x in v], (1.0, 0.97, 0.94, 0.9)[i % 4]) for i, v in enumerate(rng.normal(size=(3000, 6)).round(1))] + [(3000, "file_0", [0.0] * 6, 1.0)]
    chunks = spark.createDataFrame(rows, "chunk_key long, filename string, chunk_vec array<double>, authority_weight double").coalesce(2)
    claims = chunks.where("chunk_key % 50 = 0").select(F.col("chunk_key").alias("claim_key"), F.col("chunk_vec").alias("claim_vec"))
    scored = lambda df: df.withColumn("chunk_pos", F.col("chunk_key"))
    everything = similarity.dense_pairs(claims, chunks)
    for threshold, top_k in ((0.25, 12), (0.8, 3), (1.5, 2)):
        some = similarity.dense_pairs(claims, chunks, leading=lambda n: retrieval.Leading(n, threshold, top_k))  # noqa: B023
        want, got = (sorted(map(tuple, retrieval.retrieve(scored(df), top_k, threshold, ["claim_key"]).select("claim_key", "chunk_key", "evidence_rank", "similarity").where("claim_key < 3000").collect())) for df in (everything, some))
        assert got == want
        assert some.where("claim_key < 3000").count() < everything.count() / 10
    alone = similarity.dense_pairs(claims, chunks, leading=lambda n: retrieval.Leading(n, 0.99))
    ranked = lambda df: scored(df).withColumn("rank_score", retrieval.ranking_score(F.col("similarity"), F.col("authority_weight")))
    want, got = (sorted(map(tuple, retrieval.above_threshold(ranked(df), 0.99, ["claim_key"]).select("claim_key", "chunk_key").collect())) for df in (everything, alone))
    assert got == want


def test_files_leave_a_task_before_its_batch_is_read(spark, monkeypatch):
    """One batch of a hundred files: no more than a few are held as passages at once."""
    monkeypatch.setattr(ingest, "READ_BYTES", 1000)
    files = spark.createDataFrame([(i, f"f{i}.txt", bytearray(b"A line of words.\n" * 20)) for i in range(100)], "doc_id long, filename string, content binary").coalesce(1)
    taken = {}
    real = type(files).mapInPandas
    monkeypatch.setattr(type(files), "mapInPandas", lambda df, run, schema: taken.update(run=run, df=df) or real(df, run, schema))
    found = ingest.parse(files)
    sizes = [len(x) for x in taken["run"](iter([taken["df"].toPandas()]))]
    assert sum(sizes) == 100 and max(sizes) <= 4
    assert sorted(r["doc_id"] for r in ingest.sources(found).collect()) == list(range(100))


def test_parts_of_one_file_are_scanned_by_all_tasks(spark, tmp_path):
    rows = [(i, "n", "b", "SMALL STEEL", 3 + i % 2, 1.0) for i in range(1000)]
    spark.createDataFrame(rows, PARTS).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    per_task = queries.scanned_quantities(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("parts")).collect()
    assert sum(r["n"] for r in per_task) == sum(r["parts"] for r in per_task) == 1000
    assert len(per_task) == 4 and max(r["n"] for r in per_task) < 300


def test_a_draft_is_taken_apart_once(spark):
    """The split of a text stands once in its expression, not once for each use of a part, within functions over all parts."""
    drafts = spark.createDataFrame([("a", " ".join(f"Staff number {i} keep records." for i in range(1500)))], "k string, d string")
    plan = lambda c: drafts.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan(claims.line_sentences(F.col("d"))).count(claims.BOUNDARY) == 1
    assert plan(claims.titled_lines(F.col("d"))).count("split(") == 1
    got = [(r["claim_pos"], r["text"]) for r in claims.from_drafts(drafts, "k", "d").collect()]
    assert sorted(got) == [(i + 1, f"Staff number {i} keep records.") for i in range(1500)]
