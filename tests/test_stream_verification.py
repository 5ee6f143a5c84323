"""Drafts that arrive as files: stored once, whatever is run again, and the same as in one batch."""

from pyspark.sql import functions as F

from evidence_engine.operators import store
from evidence_engine.plans import demo, persist, verify
from evidence_engine.streaming import verification

DRAFTS = [demo.DRAFT, "The mooring fee is $40 per week for vessels under 12 metres.", "Loud engine tests are prohibited after 21 hours. Every vessel must register with the harbour office within 9 days of its arrival.", ""]


def drained(spark, s, folder, checkpoint):
    _, files = demo.package(spark)
    q = verification.verified_into(verification.draft_files(spark, folder, 2), files, s, "drafts", clock=lambda: "2024-01-01").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(600)
    assert q.exception() is None


def content(s):
    outcomes = s.table("claims").select("run_id", "claim_index", "claim_text", "outcome", "conflict_detected").collect()
    return sorted(map(tuple, outcomes)), sorted((r["id"], r["overall"], r["claim_count"], r["total_sources"]) for r in s.table("runs").collect())


def test_stream_equals_batch_and_replays_add_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, d in enumerate(DRAFTS[:3]):
        (folder / f"d{i}.txt").write_text(d)
    s = store.Store(spark, f"file://{tmp_path}/s")
    drained(spark, s, f"file://{folder}", f"file://{tmp_path}/c1")
    assert s.count() == 3 and s.batches() == {"drafts": 1} and len(s.parts()) == 2
    first = content(s)
    # the batch run of the same drafts
    _, files = demo.package(spark)
    read = spark.read.text(f"file://{folder}", wholetext=True).select(F.concat(F.lit("run_"), F.substring(F.sha2(F.concat_ws("\n", "_metadata.file_name", "value"), 256), 1, 24)).alias("run_id"), F.col("value").alias("draft"))
    other = store.Store(spark, f"file://{tmp_path}/b")
    assert other.save(persist.rows(verify.verify_files(read, files), read, "2024-01-01"))
    assert content(other) == first and {r["overall"] for r in s.table("runs").collect()} == {"VERIFIED", "REVIEW_REQUIRED"}
    one = s.get(first[1][0][0]).first()
    assert one["claims"] and one["raw_json"] and all(c["evidence"] for c in one["claims"] if c["outcome"] != "UNVERIFIED")
    # a stream that has lost its checkpoint runs its batches again
    drained(spark, s, f"file://{folder}", f"file://{tmp_path}/c2")
    assert content(s) == first and s.versions() == [1, 2]
    # a file that comes again is the same run; a new one, without claims, is stored by the next batch
    (folder / "again").mkdir()
    (folder / "again" / "d1.txt").write_text(DRAFTS[1])
    (folder / "d3.txt").write_text(DRAFTS[3] + "\n")
    drained(spark, s, f"file://{folder}", f"file://{tmp_path}/c1")
    assert s.count() == 4 and content(s)[0] == first[0] and s.batches() == {"drafts": 2}


def test_a_batch_is_saved_once(spark, tmp_path):
    from tests.test_sources import saved

    s = store.Store(spark, f"file://{tmp_path}/s")
    assert s.save(saved(spark, 1, "a"), ("x", 0)) and not s.save(saved(spark, 2, "b"), ("x", 0)) and s.save(saved(spark, 2, "b"), ("y", 0)) and s.save(saved(spark, 3, "c"), ("x", 1))
    assert s.batches() == {"x": 1, "y": 0} and s.delete("a") and s.batches() == {"x": 1, "y": 0} and s.count() == 2
    assert len([p for p in (tmp_path / "s" / "parts").iterdir()]) == 4  # three saves and what the delete wrote
