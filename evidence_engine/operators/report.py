"""The readable report of a run, as ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How outcomes are shown.
MARKS = {"SUPPORTED": "✅ SUPPORTED", "REFUTED": "❌ REFUTED"}
OTHER = "⚠️ UNVERIFIED"


def mark(outcome: Column) -> Column:
    return F.when(outcome == "SUPPORTED", MARKS["SUPPORTED"]).when(outcome == "REFUTED", MARKS["REFUTED"]).otherwise(OTHER)


def quoted(prefix: str, passage: Column, label: str) -> list[Column]:
    where = F.coalesce(passage["location"], F.concat(F.lit("Page "), passage["page"].cast("string")), F.lit("N/A"))
    return [
        F.concat(F.lit(f"> {prefix}\""), passage["text"], F.lit('"')),
        F.concat(F.lit(f"> — *{label}: `"), passage["filename"], F.lit("` ("), where, F.lit(") • Authority: `"), passage["authority_level"], F.lit("`*")),
    ]


def summary_lines(runs: DataFrame, run: str) -> DataFrame:
    """(run, part 1, pos, line): head and counts of runs with certificate_id, created_at, overall and the counts."""
    status = F.when(F.col("overall") == "VERIFIED", "🟢 VERIFIED").otherwise("🔴 REVIEW REQUIRED")
    row = lambda name, c: F.concat(F.lit(f"| {name} | **"), F.col(c).cast("string"), F.lit("** |"))
    lines = F.array(
        F.lit("# Claim Verification & Evidence Analysis Report"),
        F.concat(F.lit("**Certificate ID**: `"), "certificate_id", F.lit("`")),
        F.concat(F.lit("**Verification Timestamp**: "), "created_at"),
        F.concat(F.lit("**Overall Status**: "), status),
        F.lit(""), F.lit("---"), F.lit("## 1. Executive Summary"), F.lit("| Metric | Value |"), F.lit("| :--- | :--- |"),
        row("Total Claims Evaluated", "total_claims"), row("Claims Directly Supported", "supported"), row("Claims Refuted / Contradicted", "refuted"),
        row("Unverified Claims (Ambiguous / Missing)", "unverified"), row("Source Conflicts Detected", "conflicts_detected"),
        F.lit(""), F.lit("---"),
    )
    return runs.select(run, F.lit(1).alias("part"), F.lit(0).cast("long").alias("item"), F.posexplode(lines).alias("pos", "line"))


def source_lines(sources: DataFrame, run: str) -> DataFrame:
    scope = F.when(F.size("evidence_locations") > 0, F.concat(F.size("evidence_locations").cast("string"), F.lit(" locations"))).otherwise(F.concat(F.col("page_count").cast("string"), F.lit(" page(s)")))
    line = F.concat(F.lit("| `"), "filename", F.lit("` | `"), F.upper("file_type"), F.lit("` | `"), "authority_level", F.lit("` | `"), F.substring("sha256", 1, 16), F.lit("...` | "), scope, F.lit(" |"))
    item = F.row_number().over(Window.partitionBy(run).orderBy("filename", "sha256")).cast("long")
    rows = sources.select(run, F.lit(2).alias("part"), item.alias("item"), F.lit(0).alias("pos"), line.alias("line"))
    head = F.array(F.lit("## 2. Source Documents & Cryptographic Hashes"), F.lit("| Document Name | Format | Authority Level | SHA-256 Checksum | Evidence Scope |"), F.lit("| :--- | :--- | :--- | :--- | :--- |"))
    heads = sources.select(run).distinct().select(run, F.lit(2).alias("part"), F.lit(0).cast("long").alias("item"), F.posexplode(head).alias("pos", "line"))
    return heads.unionByName(rows)


def claim_lines(claims: DataFrame, run: str) -> DataFrame:
    """(run, part 3, item, pos, line) of claims with claim_pos, claim_id, text, outcome, confidence, reason, conflict_detected,
    primary (a passage, or null) and conflicting_evidence."""
    two = lambda c: F.format_string("%.2f", c)
    p = F.col("primary")
    head = F.array(
        F.concat(F.lit("### Claim ["), "claim_id", F.lit("]: "), mark(F.col("outcome"))),
        F.concat(F.lit('**AI Claim**: "'), "text", F.lit('"')),
        F.concat(F.lit("**Rationale**: "), "reason"),
        F.concat(F.lit("**Semantic Similarity**: `"), two(F.coalesce(p["similarity"], F.lit(0.0))), F.lit("` | **Ranking Score**: `"), two(F.coalesce(p["ranking_score"], F.lit(0.0))), F.lit("` | **Confidence**: `"), two("confidence"), F.lit("`")),
    )
    none = F.array().cast("array<string>")
    conflict = F.when(F.col("conflict_detected"), F.array(F.lit("> ⚠️ **SOURCE CONFLICT DETECTED**: Material disagreement between reference documents."))).otherwise(none)
    ground = F.when(p.isNotNull(), F.array(F.lit("**Primary Evidence Grounding**:"), *quoted("", p, "Source"))).otherwise(F.array(F.lit("*No matching evidence passage found in source materials.*")))
    others = F.flatten(F.transform("conflicting_evidence", lambda c: F.array(*quoted("❌ ", c, "Contradicting Source"))))
    against = F.when(F.size("conflicting_evidence") > 0, F.concat(F.array(F.lit("**Conflicting Evidence Passages**:")), others)).otherwise(none)
    lines = F.concat(head, conflict, ground, against, F.array(F.lit("")))
    return claims.select(run, F.lit(3).alias("part"), F.col("claim_pos").cast("long").alias("item"), F.posexplode(lines).alias("pos", "line"))


def config_lines(runs: DataFrame, run: str, config: dict[str, str]) -> DataFrame:
    lines = [F.lit("---"), F.lit("## 4. Audit Metadata & Reproducibility"), *[F.lit(f"- **{k}**: `{v}`") for k, v in config.items()]]
    return runs.select(run, F.lit(4).alias("part"), F.lit(0).cast("long").alias("item"), F.posexplode(F.array(*lines)).alias("pos", "line"))


def assembled(lines: DataFrame, run: str) -> DataFrame:
    """(run, report): the lines in order, joined by line feeds."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "item", "pos", "line")))
    return lines.groupBy(run).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("report"))
