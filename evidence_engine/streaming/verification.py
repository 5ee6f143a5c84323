"""Verification of drafts as they arrive: every micro-batch is verified and stored once."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from evidence_engine.operators.store import Store
from evidence_engine.plans import persist, verify
from evidence_engine.plans.staging import cut


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def draft_files(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of drafts (run_id, draft): each new text file below a folder is one. Its run's id follows from its name and its
    content, so a file that is delivered again under its name is the same run."""
    read = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(folder)
    run = F.concat(F.lit("run_"), F.substring(F.sha2(F.concat_ws("\n", "_metadata.file_name", "value"), 256), 1, 24))
    return read.select(run.alias("run_id"), F.col("value").alias("draft"))


def verified_into(drafts: DataFrame, files: DataFrame, into: Store, name: str, authorities: DataFrame | None = None, config: verify.Config = verify.Config(), clock: Callable[[], str] = now) -> DataStreamWriter:
    """A writer that verifies a stream of drafts (run_id, draft) against files (filename, content) into a store; the caller sets
    checkpoint and trigger, and starts it.

    The store records the number of the last batch of the stream of this name in the same step as its rows, so a batch that is
    run again, after whatever failed, adds nothing. Of drafts with one run_id in a batch one is taken, and runs that the store
    has already are left out, so a file that comes a second time is no error.
    """

    def once(batch: DataFrame, number: int) -> None:
        if into.batches().get(name, -1) >= number:
            return
        new = cut(batch.dropDuplicates(["run_id"]).join(into.table("runs").select(F.col("id").alias("run_id")), "run_id", "left_anti"))
        if new.isEmpty():
            return
        found = verify.verify_files(new, files, authorities, config)
        into.save(persist.rows(found, new, clock(), config), (name, number))

    return drafts.writeStream.foreachBatch(once)
