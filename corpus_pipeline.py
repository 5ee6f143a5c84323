"""The corpus pipeline: from raw documents to packed training sequences, one operator a stage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet in the shared folder and read again as
the next one's docs. All but the last return the columns of documents. Nulls are what the stage's operator says of them. Rows
that repeat a doc_id stay or go together, whatever their texts are: one rejected text rejects them all. Only the removal of
repeats treats each text for itself, and packing packs every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.llm import decontaminate, language, near_dedup, packing, substrings
from evidence_engine.llm.common import staged
from evidence_engine.llm.queries import tokenizer_path

#: Documents whose list of n-grams has less in common with every profile are in no known language.
LEAST_SCORE = 0.1
#: Columns of documents, in order.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or in no known language, whatever lang they bear. What the model learns from and the
    others are treated alike. Rows without doc_id stay as they are."""
    found = language.identify(docs)
    unknown = (F.col("lang_pred") == language.UNKNOWN) | (F.col("score") < LEAST_SCORE)
    gone = staged(found.where(unknown & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "gone")
    return substrings.with_ids(docs.select(*COLUMNS), gone, "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near duplicates (shingles of five words, similarity 0.8)."""
    classes = near_dedup.near_duplicates(docs, size=5, percent=80)
    gone = staged(classes.where("not kept and doc_id is not null").select("doc_id").distinct(), "gone")
    return substrings.with_ids(docs.select(*COLUMNS), gone, "left_anti")


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes strings of 50 bytes that a document with a smaller id has out of the texts; documents of which nothing is left go."""
    docs = docs.select(*COLUMNS)
    cut = substrings.deduplicated(docs, keep_text=True)
    cut = staged(cut.where("n_removed > 0 and doc_id is not null").select("doc_id", "sha", "kept_text").dropDuplicates(["doc_id", "sha"]), "cut")
    whole, ids = docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), cut.select("doc_id").distinct()
    # only texts of documents that lose something are moved
    touched = substrings.with_ids(whole, ids, "left_semi").join(cut, ["doc_id", "sha"], "left")
    changed = F.col("kept_text").isNotNull()
    touched = touched.where(~changed | (F.trim("kept_text") != ""))
    touched = touched.select("doc_id", F.coalesce("kept_text", "text").alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
    return substrings.with_ids(docs, ids, "left_anti").unionByName(touched)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item of benchmark."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = staged(found.where("doc_id is not null").select("doc_id").distinct(), "gone")
    return substrings.with_ids(docs.select(*COLUMNS), gone, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", remove_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Language profiles, edit distances and byte pair merging are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, f"stage-{name}")
    return docs
