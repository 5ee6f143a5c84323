"""Admission in the order of event times: shuffled and late requests are decided as in one ordered table."""

import random

from pyspark.sql import functions as F

from evidence_engine.streaming import admission


def test_late_requests_are_decided_in_their_order(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted((c, round(1_000 + rng.random() * 300, 3), False) for c in ("a", "b", "c") for _ in range(40)) + [("a", 1_150.5, True), ("gone", 1_001.0, False)]
    # in batches by time, each request up to 30 seconds later than its turn, and a last one that lets the watermark pass all
    rows.sort(key=lambda r: r[1] + rng.random() * 30)
    parts = [rows[i : i + 25] for i in range(0, len(rows), 25)] + [[("end", 2_000.0, False)], [("end", 2_000.5, False)]]
    schema = "client string, t double, reset boolean"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).select("client", F.timestamp_seconds("t").alias("ts"), "reset").coalesce(1).write.parquet(f"file://{tmp_path}/in/p{i:02d}")
    stream = spark.readStream.schema("client string, ts timestamp, reset boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    q = admission.ordered_admission_stream(stream, "40 seconds", 3, 60.0).writeStream.format("memory").queryName("ordered").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(600)
    assert q.exception() is None
    got = sorted((r["client"], r["ts"], r["allowed"], r["retry_after"]) for r in spark.sql("SELECT * FROM ordered WHERE client <> 'end'").collect())
    table = spark.createDataFrame(rows, schema).select("client", F.timestamp_seconds("t").alias("ts"), "reset")
    want = sorted((r["client"], r["ts"], r["allowed"], r["retry_after"]) for r in admission.admissions(table, 3, 60.0).collect())
    assert got == want and any(not r[2] for r in got) and len(got) == 121
    # clients that are quiet have no state left
    left = q.lastProgress.stateOperators[0].numRowsTotal
    assert left <= 6
