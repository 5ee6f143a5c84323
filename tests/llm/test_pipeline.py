import re

import corpus_pipeline
from evidence_engine.llm import queries

from .helpers import DOCS, awkward, documents, prose


def tables(spark, tmp_path, docs):
    path = f"file://{tmp_path}"
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, prose(70, 40)), (1, prose(71, 30))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect(spark, tmp_path):
    passage = prose(900, 60)
    texts = [prose(i, 120) for i in range(30)]
    texts[3] = texts[2]
    texts[5] = texts[4] + " extra"
    texts[7] = prose(7, 60) + " " + prose(70, 40) + " " + prose(77, 60)
    texts[10], texts[11] = texts[10] + " " + passage, passage + " " + texts[11]
    texts += [None, "123 456"]
    path = tables(spark, tmp_path, documents(spark, texts))
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        if name != "packing":
            assert [f"{f.name} {f.dataType.simpleString().replace('bigint', 'long')}" for f in docs.schema.fields] == DOCS.split(", ")
            docs = docs.cache()
            seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(range(30)) - set(seen["language"]) == set() and not {30, 31} & set(seen["language"])
    assert set(seen["language"]) - set(seen["near_duplicates"]) == {3, 5}
    assert seen["repeats"][10] == texts[10] and passage[:80] not in seen["repeats"][11] and texts[11][-200:] in seen["repeats"][11]
    assert set(seen["repeats"]) - set(seen["decontamination"]) == {7}
    packed = docs.collect()
    assert {r["doc_id"] for r in packed} == set(seen["decontamination"])
    assert sorted((r["doc_id"], r["start"]) for r in corpus_pipeline.run(spark, path).collect()) == sorted((r["doc_id"], r["start"]) for r in packed)


def test_awkward_documents_pass_through(spark, tmp_path):
    path = tables(spark, tmp_path, awkward(spark).drop("n", "id"))
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in rows} >= {0, 5} and not {2, 3, 4, 9} & {r["doc_id"] for r in rows}
    empty = tables(spark, tmp_path / "empty", documents(spark, []))
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_registered_queries_name_their_operators():
    names = [n for n in queries.QUERIES if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "decontamination", "packing"]
