"""A verification as rows of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.functions import text
from evidence_engine.operators import rollup, store
from evidence_engine.plans.staging import cut
from evidence_engine.plans.verify import Config, Verification


def rows(found: Verification, drafts: DataFrame, created_at: str, config: Config = Config()) -> dict[str, DataFrame]:
    """What Store.save() takes: runs, claims, evidence and certificates of a verification of drafts (run_id, draft).

    A run's certificate names the sources that its evidence comes from. Ids follow from the run and the place in it. A run
    without claims is stored with counts of 0.
    """
    results = cut(found.results)
    run = F.col("run_id").cast("string")
    claim = F.concat_ws("_", run, "claim_id")
    lists = F.array(
        F.struct(F.lit("primary").alias("list"), F.array("primary").alias("items")),
        *[F.struct(F.lit(name).alias("list"), F.col(column).alias("items")) for name, column in (("supporting", "supporting_evidence"), ("evidence", "evidence"), ("conflicting", "conflicting_evidence"))],
    )
    each = results.select(run.alias("run_id"), claim.alias("claim_id"), F.explode(lists).alias("l")).select("run_id", "claim_id", "l.list", F.posexplode("l.items").alias("pos", "x")).where("x is not null")
    passages = each.select("run_id", "claim_id", "list", "pos", F.col("x.filename").alias("source"), *[f"x.{c}" for c in ("source_id", "location", "page", "text", "similarity", "ranking_score", "authority_level", "authority_weight")])
    evidence = store.evidence_rows(passages, "claim_id")
    named = evidence.select("run_id", F.col("source").alias("filename")).distinct()
    sources = named.join(found.sources.select("filename", "sha256").distinct(), "filename")
    known = drafts.select(run.alias("run_id"), F.coalesce(F.col("draft").cast("string"), F.lit("")).alias("draft"))
    counts = known.select("run_id").join(found.summary.withColumn("run_id", run), "run_id", "left").na.fill(0, ["total_claims", "supported", "refuted", "unverified", "conflicts_detected"]).na.fill(rollup.REVIEW, ["overall"])
    certificates = cut(rollup.certificates(counts, results.select(run.alias("run_id"), "claim_pos", "claim_id", "text", "outcome"), sources, "run_id", created_at, config.labels()))
    said = known.select("run_id", F.sha2("draft", 256).alias("input_hash"), text.snippet(F.col("draft")).alias("draft_snippet"))
    of_sources = sources.groupBy("run_id").agg(F.count("*").cast("int").alias("total_sources"))
    first = F.col("primary")
    runs = certificates.select("run_id", "certificate_id", "created_at", "overall", *counts.columns[1:-1]).join(said, "run_id").join(of_sources, "run_id", "left")
    none = lambda kind: F.lit(None).cast(kind)
    return {
        "runs": runs.select(
            F.col("run_id").alias("id"), "certificate_id", "created_at", "overall", F.col("total_claims").alias("claim_count"), F.col("supported").alias("supported_count"), F.col("refuted").alias("refuted_count"), F.col("unverified").alias("unverified_count"),
            "conflicts_detected", F.coalesce("total_sources", F.lit(0)).alias("total_sources"), none("double").alias("execution_time_seconds"), none("double").alias("avg_time_per_claim_ms"), "input_hash", "draft_snippet",
        ),
        "claims": results.select(
            claim.alias("id"), run.alias("run_id"), F.col("claim_pos").alias("claim_index"), F.col("text").alias("claim_text"), F.col("text").alias("original_sentence"), "outcome", "confidence", "reason", first["similarity"].alias("similarity_score"),
            first["ranking_score"].alias("ranking_score"), first["authority_level"].alias("source_authority"), "conflict_detected", none("double").alias("processing_time_ms"),
        ),
        "evidence": evidence.select(
            F.concat_ws("_ev", "claim_id", F.col("evidence_pos").cast("string")).alias("id"), "claim_id", F.col("source").alias("source_filename"), "source_id", "location", F.lower(F.substring_index("location", " ", 1)).alias("location_type"), "page",
            text.evidence_snippet(F.col("text")).alias("snippet_text"), "similarity", "ranking_score", "authority_level", "authority_weight", "is_primary", "is_conflict",
        ),
        "certificates": certificates.join(said, "run_id").select("certificate_id", "run_id", "certificate_version", "created_at", "overall", "input_hash", "raw_json", "sha256_hash"),
    }
