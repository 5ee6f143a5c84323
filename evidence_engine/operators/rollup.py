"""Runs from claims: counts, overall outcome and the certificate row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERIFIED, REVIEW = "VERIFIED", "REVIEW_REQUIRED"
#: Version of the certificate's layout. A fixed value.
VERSION = "1.1"


def overall(total: Column, supported: Column, conflicts: Column) -> Column:
    """Verified only if there are claims, all supported, without a conflict."""
    return F.when((total > 0) & (supported == total) & (conflicts == 0), VERIFIED).otherwise(REVIEW)


def summary(claims: DataFrame, run: list[str]) -> DataFrame:
    """Counts of claims (run columns, outcome, conflict_detected) by outcome, conflicts, and the overall outcome of each run."""
    of = lambda o: F.count_if(F.col("outcome") == o)
    counts = claims.groupBy(*run).agg(
        F.count("*").alias("total_claims"), of("SUPPORTED").alias("supported"), of("REFUTED").alias("refuted"), of("UNVERIFIED").alias("unverified"), F.count_if("conflict_detected").alias("conflicts_detected")
    )
    return counts.withColumn("overall", overall(F.col("total_claims"), F.col("supported"), F.col("conflicts_detected")))


def timings(claims: DataFrame, run: list[str]) -> DataFrame:
    """Seconds of each run and milliseconds a claim, from claims (run columns, processing_time_ms)."""
    total = F.sum("processing_time_ms")
    return claims.groupBy(*run).agg(F.round(total / 1000.0, 4).alias("total_time_seconds"), F.round(total / F.count("*"), 2).alias("avg_time_per_claim_ms"))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of parts joined by line feeds; nulls are empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def certificates(summaries: DataFrame, claims: DataFrame, sources: DataFrame, run: str, created_at: str, config: dict[str, str]) -> DataFrame:
    """One row a run: certificate_id, the summary, claims and sources as arrays, raw_json and its hash. The id follows from the
    run and its input, so it is the same whenever the run is."""
    per_claim = claims.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("claim_pos", *[c for c in claims.columns if c not in (run, "claim_pos")]))).alias("claims"))
    per_source = sources.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(*[c for c in sources.columns if c != run]))).alias("sources"))
    rows = summaries.join(per_claim, run, "left").join(per_source, run, "left")
    settings = F.create_map(*[F.lit(x) for kv in sorted(config.items()) for x in kv])
    rows = rows.withColumns({"certificate_version": F.lit(VERSION), "created_at": F.lit(created_at), "configuration": settings})
    rows = rows.withColumn("certificate_id", F.concat(F.lit("vc_"), F.substring(fingerprint(F.col(run), F.to_json(F.col("claims"))), 1, 12)))
    rows = rows.withColumn("raw_json", F.to_json(F.struct(*[c for c in rows.columns])))
    return rows.withColumn("sha256_hash", F.sha2("raw_json", 256))
