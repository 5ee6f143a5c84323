"""Inverted lists of dense vectors against the exhaustive search."""

import numpy as np
import pytest

from evidence_engine.operators import centroids


def table(spark, rows):
    return spark.createDataFrame([(i, None if r is None else [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, vec array<float>")


def nearest(rows, q, k):
    m = np.array([np.zeros(rows.shape[1]) if not r.any() else r / np.linalg.norm(r) for r in rows.astype(np.float32).astype(float)])
    near = np.round(m @ m[q], 9)
    return sorted(range(len(rows)), key=lambda i: (-near[i], i))[:k]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(15, 16))
    return np.concatenate([m + 0.4 * rng.normal(size=(60, 16)) for m in middle])


def test_all_probes_are_the_exhaustive_search(spark, clustered):
    df = table(spark, clustered)
    index = centroids.build(df, "vec_id")
    asked = df.where("vec_id % 50 = 0")
    found = centroids.search(index, asked.withColumnRenamed("vec_id", "q"), "q", 7, len(index.centroids)).collect()
    got = {q: [r.key for r in sorted(found, key=lambda r: r["rank"]) if r.q == q] for q in range(0, 900, 50)}
    assert got == {q: nearest(clustered, q, 7) for q in range(0, 900, 50)} and len(index.centroids) == 30


def test_recall_of_few_probes(spark, clustered):
    df = table(spark, clustered)
    index = centroids.build(df, "vec_id", k=10, recall=0.97)
    assert index.lists.count() == 900 and 1 <= index.probes < len(index.centroids)
    asked = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "q")
    exact = centroids.search(index, asked, "q", 10, len(index.centroids))
    one = centroids.recall(centroids.search(index, asked, "q", 10), exact, "q").first()
    assert one["queries"] == 18 and one["neighbours"] == 180 and one["recall"] >= 0.95


def test_blocks_of_queries_and_string_keys(spark, clustered, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK_NUMBERS", 64)
    df = table(spark, clustered[:200]).selectExpr("concat('v', vec_id) AS name", "vec")
    index = centroids.build(df, "name", lists=4)
    found = centroids.search(index, df.where("name in ('v0', 'v50', 'v150', 'v77', 'v78', 'v79', 'v80')").withColumnRenamed("name", "q"), "q", 1, 4).collect()
    assert sorted((r.q, r.key, r.similarity) for r in found) == sorted((f"v{i}", f"v{i}", 1.0) for i in (0, 50, 150, 77, 78, 79, 80))


def test_odd_vectors(spark):
    """Nulls, zeros, ties and an empty table."""
    df = table(spark, [[1, 0], None, [0, 0], [2, 0], [0, 1], [1, 0]])
    index = centroids.build(df, "vec_id")
    found = centroids.search(index, df.withColumnRenamed("vec_id", "q"), "q", 3, 99).orderBy("q", "rank").collect()
    assert [(r.key, r.similarity) for r in found if r.q == 0] == [(0, 1.0), (3, 1.0), (5, 1.0)]
    assert [(r.key, r.similarity) for r in found if r.q == 1] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    empty = centroids.build(df.limit(0), "vec_id")
    assert centroids.search(empty, df.withColumnRenamed("vec_id", "q"), "q").count() == 0
    assert centroids.search(index, df.limit(0).withColumnRenamed("vec_id", "q"), "q").count() == 0
