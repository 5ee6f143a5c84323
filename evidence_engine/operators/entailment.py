"""Outcomes of (claim, passage) pairs by a ladder of rules, and of claims from those of their passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_engine.functions import quantities, text

SUPPORTED, REFUTED, UNVERIFIED = "SUPPORTED", "REFUTED", "UNVERIFIED"
# Reasons and thresholds of the ladder.
RELEVANT = 0.35
NO_EVIDENCE = "No relevant evidence was found in the uploaded source documents."
NO_TEXT = "No extractable text or evidence was available from uploaded source documents."


def features(claims: DataFrame, column: str = "text", prefix: str = "claim") -> DataFrame:
    """Adds what the ladder needs to know of claims or passages, once for each and before any join."""
    t = F.trim(F.col(column))
    tokens = text.letters(t)
    facts = t if prefix == "claim" else text.without_directives(t)
    out = claims.withColumn(f"{prefix}_facts", facts).withColumn(f"{prefix}_tokens", tokens)
    marks = {
        "words": text.keywords(F.col(f"{prefix}_tokens")),
        "negated": text.has_any(F.col(f"{prefix}_tokens"), text.NEGATIONS),
        "allows": text.has_any(F.col(f"{prefix}_tokens"), text.ALLOWING),
        "prohibits": text.has_any(F.col(f"{prefix}_tokens"), text.PROHIBITING),
    }
    out = out.withColumns({f"{prefix}_{k}": v for k, v in marks.items()}).drop(f"{prefix}_tokens")
    return out.withColumn(f"{prefix}_quantities", quantities.quantities(f"{prefix}_facts"))


def overlap() -> Column:
    """Share of the claim's content words that the passage has."""
    return F.size(F.array_intersect("claim_words", "passage_words")) / F.size("claim_words")


def ladder(contradiction: Column, is_grounded: Column, share: Column, where: Column, passage: Column) -> Column:
    """The rules in order, as a struct of outcome, confidence and reason, over columns similarity, filename, claim_facts,
    passage_facts and the marks that features() gives."""
    similarity, source = F.col("similarity"), F.col("filename")
    place = F.concat(source, F.lit(" ("), where, F.lit(")"))
    say = lambda outcome, confidence, *reason: F.struct(F.lit(outcome).alias("outcome"), confidence.alias("confidence"), F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in reason]).alias("reason"))
    known = F.round(similarity, 2)
    vague = say(UNVERIFIED, known, "Evidence in ", place, " discusses related concepts but does not corroborate the specific quantitative figures in the claim.")
    clash = (F.col("claim_allows") & F.col("passage_prohibits")) | (F.col("claim_prohibits") & F.col("passage_allows"))
    return (
        F.when(F.col("passage_facts") == "", say(UNVERIFIED, F.lit(0.0), "Retrieved passage contains instruction directives without verifiable factual assertions."))
        .when(text.inquiry(F.col("claim_facts")), say(UNVERIFIED, F.lit(0.0), "Instruction inquiry cannot be verified as an empirical factual claim."))
        .when(similarity < RELEVANT, say(UNVERIFIED, known, "Closest retrieved passage in ", source, " has insufficient semantic relevance (similarity ", F.format_string("%.2f", similarity), ")."))
        .when(contradiction.isNotNull(), say(REFUTED, F.lit(0.95), contradiction, " Located in ", place, "."))
        .when(F.size("claim_words") == 0, say(UNVERIFIED, F.lit(0.0), "Claim lacks verifiable factual keywords."))
        .when(clash & (share >= 0.35), say(REFUTED, F.lit(0.92), "Direct regulatory contradiction: Claim asserts permission/prohibition contradicted by source in ", place, "."))
        .when(F.col("claim_negated") & ~F.col("passage_negated") & (share >= 0.60), say(REFUTED, F.lit(0.90), "Contradictory polarity: Claim negates source requirement in ", place, "."))
        .when((share >= 0.45) & (similarity >= 0.50), F.when(~is_grounded, vague).otherwise(say(SUPPORTED, F.round(F.least(F.lit(0.96), similarity + 0.1), 2), "Evidence directly confirms claim: '", F.substring(passage, 1, 120), "...' in ", place, ".")))
        .when((share >= 0.35) & (similarity >= 0.70), F.when(~is_grounded, vague).otherwise(say(SUPPORTED, F.round(F.least(F.lit(0.92), similarity), 2), "Evidence confirms claim meaning in ", place, ".")))
        .otherwise(say(UNVERIFIED, known, "Evidence in ", place, " is related but does not fully establish or contradict the claim."))
    )


def judge(pairs: DataFrame) -> DataFrame:
    """Adds outcome, confidence and reason to pairs with the features of both sides, filename, location, page and text."""
    where = F.coalesce("location", F.concat(F.lit("Page "), F.col("page").cast("string")), F.lit("Source Document"))
    seen = pairs.withColumn("_stated", quantities.stated(F.col("claim_quantities"), F.col("passage_quantities"), F.col("passage_facts")))
    seen = seen.withColumn("_against", quantities.contradiction(F.col("claim_quantities"), F.col("passage_quantities")))
    judged = seen.withColumn("_j", ladder(F.col("_against"), F.col("_stated"), overlap(), where, F.trim("text")))
    return judged.select(*pairs.columns, "_j.*")


def relevant(pairs: DataFrame) -> DataFrame:
    """The first passage of a claim, and the others that are relevant enough."""
    return pairs.where((F.col("evidence_rank") == 1) | (F.col("similarity") >= RELEVANT))


def claim_outcomes(judged: DataFrame, claim: list[str], conflicts: bool = True) -> DataFrame:
    """One row a claim: outcome, confidence, reason, conflict, the primary passage and arrays of supporting and conflicting ones.

    judged has the claim columns, evidence_rank, filename, source_id, chunk_id, location, authority_level, outcome, confidence,
    reason and what else belongs to a passage. A passage counts once by chunk_id among the supporting and once among the
    conflicting; a pair of them from different sources is a conflict, in which the claim counts as supported.
    """
    if not conflicts:
        judged = judged.where(F.col("evidence_rank") == 1)
    names = [c for c in judged.columns if c not in claim]
    item = F.struct(F.col("evidence_rank").alias("_r"), *[F.col(c) for c in names if c != "evidence_rank"], F.col("evidence_rank").alias("evidence_rank"))
    rows = judged.groupBy(*claim).agg(F.array_sort(F.collect_list(item)).alias("all"))
    first_of = lambda xs: F.filter(xs, lambda x: ~F.exists(xs, lambda y: (y["_r"] < x["_r"]) & y["chunk_id"].eqNullSafe(x["chunk_id"])))
    with_outcome = lambda o: F.filter("all", lambda x: x["outcome"] == o)
    rows = rows.withColumns({"supporting": with_outcome(SUPPORTED), "refuting": with_outcome(REFUTED)})
    rows = rows.withColumns({"supporting": first_of(F.col("supporting")), "refuting": first_of(F.col("refuting"))})
    apart = lambda s, c: (s["filename"] != c["filename"]) | F.coalesce(s["source_id"] != c["source_id"], F.lit(False))
    rows = rows.withColumn("ground", F.get(F.filter("supporting", lambda s: F.exists("refuting", lambda c: apart(s, c))), F.lit(0)))
    rows = rows.withColumn("against", F.get(F.filter("refuting", lambda c: apart(F.col("ground"), c)), F.lit(0)))
    conflict = F.col("ground").isNotNull()
    support, refute = F.get("supporting", F.lit(0)), F.get("refuting", F.lit(0))
    primary = F.coalesce("ground", support, refute, F.get("all", F.lit(0)))
    other = F.filter("refuting", lambda c: c["filename"] != F.col("ground")["filename"])
    none = F.filter("refuting", lambda c: F.lit(False))
    told = lambda x: F.concat(x["filename"], F.lit(" ("), F.coalesce(x["location"], F.lit("N/A")), F.lit(", "), x["authority_level"], F.lit(")"))
    reason = F.concat(F.lit("Source conflict detected: Grounded by "), told(F.col("ground")), F.lit(", but materially contradicted by "), told(F.col("against")), F.lit(". Review required."))
    # confidence and reason are those of the first passage with the primary one's chunk_id
    named = F.get(F.filter("all", lambda x: x["chunk_id"].eqNullSafe(F.col("primary")["chunk_id"])), F.lit(0))
    rows = rows.withColumn("primary", primary).withColumn("_named", named)
    return rows.select(
        *claim,
        F.when(conflict | (F.size("supporting") > 0), SUPPORTED).when(F.size("refuting") > 0, REFUTED).otherwise(UNVERIFIED).alias("outcome"),
        F.col("_named")["confidence"].alias("confidence"),
        F.when(conflict, reason).otherwise(F.col("_named")["reason"]).alias("reason"),
        conflict.alias("conflict_detected"),
        "primary",
        F.col("supporting").alias("supporting_evidence"),
        F.when(conflict, F.when(F.size(other) > 0, other).otherwise(F.array("against"))).when(F.size("supporting") > 0, none).otherwise(F.col("refuting")).alias("conflicting_evidence"),
        F.col("all").alias("evidence"),
    )
