"""Snapshots of the store: readers, writers that meet, deletes and what is left on disk."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evidence_engine.functions import text
from evidence_engine.operators import store
from tests.test_sources import saved


def texts_on_disk(spark, path):
    files = [str(p) for p in Path(path).rglob("*.parquet") if "/claims/" in str(p)]
    return sorted(r["run_id"] for r in spark.read.schema(store.TABLES["claims"]).parquet(*[f"file://{f}" for f in files]).collect()) if files else []


def ids(s, version=None):
    return sorted(r["id"] for r in s.table("runs", version).collect())


def test_readers_keep_their_version(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.save(saved(spark, 1, "a"))
    s.save(saved(spark, 2, "b"))
    before, parts = s.tables(), s.parts()
    assert s.delete("vc_a") and not s.delete("a") and s.versions() == [1, 2, 3]
    # the open reader has both runs whole, new readers one
    assert before["runs"].count() == 2 and before["claims"].count() == 2 and before["evidence"].count() == 2
    assert ids(s) == ["b"] and ids(s, 2) == ["a", "b"] and ids(s, 1) == ["a"]
    assert len(set(parts) & set(s.parts())) == 1  # the part without the run is the same
    assert texts_on_disk(spark, tmp_path) == ["a", "b"]
    assert s.vacuum() == 1 and s.versions() == [3] and ids(s) == ["b"] and texts_on_disk(spark, tmp_path) == ["b"]
    assert s.vacuum() == 0 and s.delete("b") and s.count() == 0 and s.vacuum() == 1 and texts_on_disk(spark, tmp_path) == []


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    """Whoever comes second builds on what came first."""
    path = f"file://{tmp_path}/s"
    one, two = store.Store(spark, path), store.Store(spark, path)
    one.save(saved(spark, 1, "a"))
    publish, done = store.Store._publish, []

    def late(self, version, *rest):
        if self is one and not done:
            done.append(1)
            two.save(saved(spark, 2, "b"))
        return publish(self, version, *rest)

    monkeypatch.setattr(store.Store, "_publish", late)
    one.save(saved(spark, 3, "c"))
    assert ids(one) == ["a", "b", "c"] and one.versions() == [1, 2, 3]
    done.clear()
    two.delete("b")  # so that the other can save it again
    done.clear()
    with pytest.raises(ValueError):  # the same run, saved by both: it is refused on the second look
        one.save(saved(spark, 4, "b"))
    assert ids(one) == ["a", "b", "c"]
    done.append(1)
    assert two.delete("b")
    done.clear()
    assert one.delete("a") and ids(one) == ["b", "c"]
    one.vacuum()
    assert texts_on_disk(spark, tmp_path) == ["b", "c"] and len([p for p in (tmp_path / "s" / "parts").iterdir()]) == len(one.parts())
    monkeypatch.setattr(store.Store, "_publish", lambda self, *rest: False)
    with pytest.raises(store.Conflict):
        one.save(saved(spark, 5, "d"))
    monkeypatch.undo()
    assert ids(one) == ["b", "c"] and one.vacuum() == 0  # nothing of the failed write is left


def test_a_version_is_published_once(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.create()
    assert s._publish(1, ["x"]) and not s._publish(1, ["y"]) and s.parts() == ["x"]
    assert sorted(p.name for p in (tmp_path / "s" / "manifests").iterdir() if not p.name.startswith(".")) == ["v0000000001.json"]


def test_compaction(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    assert not s.compact()
    for n in range(3):
        s.save(saved(spark, n, f"r{n}"))
    assert not s.compact(4) and s.compact() and len(s.parts()) == 1 and ids(s) == ["r0", "r1", "r2"] and s.vacuum() == 3
    assert s.delete("r1") and ids(s) == ["r0", "r2"] and s.get("r0").first()["claims"][0]["evidence"]


def test_certificates_as_files(spark, tmp_path):
    rows = [(f"vc_{i}", json.dumps({"certificate_id": f"vc_{i}", "note": "line\nbreak", "n": i}, indent=1)) for i in range(300)]
    folder = f"file://{tmp_path}/certs"
    store.write_certificates(spark.createDataFrame(rows, "certificate_id string, raw_json string"), folder)
    assert 100 < len([p for p in (tmp_path / "certs").iterdir() if p.name.startswith("bucket=")]) <= store.BUCKETS
    s = store.Store(spark, f"file://{tmp_path}/s")
    for i in (0, 7, 299):
        found = s.certificate(f"vc_{i}", folder).collect()
        assert len(found) == 1 and json.loads(found[0]["raw_json"]) == json.loads(rows[i][1])
    assert s.certificate("vc_300", folder).count() == 0 and s.certificate("../vc_1", folder).count() == 0 and s.certificate("*", folder).count() == 0
    (tmp_path / "certs" / "vc_own.json").write_text('{\n "certificate_id": "vc_own",\n "n": 1\n}')
    assert json.loads(s.certificate("vc_own", folder).first()["raw_json"])["n"] == 1
    store.write_certificates(spark.createDataFrame(rows[:1], "certificate_id string, raw_json string"), folder)
    assert s.certificate("vc_0", folder).count() == 1


def test_places_inside_a_folder(spark):
    names = ["a.txt", "../../etc/passwd", "..", "x/../../y.md", "/abs/z.csv", "..\\..\\w.txt", "", None, "....//", "ok/.hidden", "a\0b.txt"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(text.inside("/data/", F.col("n"))).collect()]
    assert all(p is None or p.startswith("/data/") and "/" not in p[6:] and p[6:] not in ("", ".", "..") for p in got)
    assert got[0] == "/data/a.txt" and got[1] == "/data/passwd" and got[4] == "/data/z.csv"


def test_of_one_run_nothing_else_is_shuffled(spark, tmp_path, monkeypatch):
    """A run that is read or deleted is looked for where the rows are; so are the ids of a small save."""
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.save(saved(spark, 1, "a"))
    s.save(saved(spark, 2, "b"))
    real, taken = store.detail, {}
    monkeypatch.setattr(store, "detail", lambda tables, run: taken.update(tables) or real(tables, run))
    found = s.get("vc_a").first()
    assert found["id"] == "a" and len(found["claims"]) == 1 and len(found["claims"][0]["evidence"]) == 1 and found["raw_json"]
    assert {name: df.count() for name, df in taken.items()} == dict.fromkeys(store.TABLES, 1)
    gone = spark.createDataFrame([("a",)], "id string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (*taken.values(), *store.delete_cascade(s.tables(), F.broadcast(gone), few=True).values()):
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    with pytest.raises(ValueError, match="runs: id is there already"):
        s.save(saved(spark, 3, "b"))
    assert ids(s) == ["a", "b"]
