"""The labelled benchmark: cases through the whole verification, outcomes against the truth, results kept for the next reader."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.operators import evaluation
from evidence_engine.plans.verify import Config, verify_files

CASE = "claim_id string, claim string, truth string, predicted string, confidence double, reason string, hit boolean"


@dataclass
class Evaluation:
    """DataFrames of an evaluation: one row a case, and the measures over all of them."""

    cases: DataFrame
    accuracy: DataFrame
    retrieval: DataFrame
    classes: DataFrame
    macro_f1: DataFrame
    confusion: DataFrame


def judged_cases(spark: SparkSession, path: str, config: Config) -> DataFrame:
    """Every case of a JSON file verified as a run of its own against the file's source, as CASE. A case's outcome is that of its
    first claim; hit tells whether a keyword stands in its evidence, null for a case without keywords."""
    cases = evaluation.read_cases(spark, path)
    files = cases.select(F.col("source_document").alias("filename"), F.col("source_content").cast("binary").alias("content")).distinct()
    drafts = cases.select(F.col("claim_id").alias("run_id"), F.col("claim").alias("draft"))
    found = verify_files(drafts, files, config=config).results.where("claim_pos = 1")
    seen = found.select(F.col("run_id").alias("claim_id"), F.explode("evidence").alias("e")).select("claim_id", "e.text")
    hits = evaluation.hits(cases.select("claim_id", "keywords"), seen, "claim_id")
    outcomes = found.select(F.col("run_id").alias("claim_id"), F.col("outcome").alias("predicted"), "confidence", "reason")
    rows = cases.join(outcomes, "claim_id", "left").join(hits, "claim_id", "left")
    return rows.select("claim_id", "claim", "truth", F.coalesce("predicted", F.lit("UNVERIFIED")).alias("predicted"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "reason", "hit")


def evaluate(spark: SparkSession, path: str, config: Config = Config(), cache: str | None = None, fresh: bool = False) -> Evaluation:
    """Evaluates the cases of a JSON file. With a cache folder the judged cases are written there, and read from there the next
    time unless fresh is asked for."""
    rows = None
    if cache and not fresh:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/_SUCCESS")
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            rows = spark.read.schema(CASE).parquet(cache)
    if rows is None:
        rows = judged_cases(spark, path, config)
        if cache:
            rows.write.mode("overwrite").parquet(cache)
            rows = spark.read.schema(CASE).parquet(cache)
    classes = evaluation.class_metrics(rows)
    return Evaluation(rows, evaluation.accuracy(rows), evaluation.retrieval_precision(rows.where("hit is not null").select("claim_id", "hit")), classes, evaluation.macro_f1(classes), evaluation.confusion(rows))
