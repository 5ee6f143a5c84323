"""Ranking: authority-weighted scores, threshold with fallback, the best passage of every source, and what fills up to top_k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_score(similarity: Column, weight: Column, weighted: bool = True) -> Column:
    """Similarity, with a quarter of it depending on the source's authority; both clamped to their ranges."""
    if not weighted:
        return F.round(similarity, 4)
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity))
    w = F.greatest(F.lit(0.5), F.least(F.lit(1.0), weight))
    return F.round(s * (F.lit(0.75) + F.lit(0.25) * w), 4)


def best_first() -> list[Column]:
    return [F.desc("rank_score"), F.desc("similarity"), F.asc("chunk_pos")]


def above_threshold(scored: DataFrame, threshold: float, claim: list[str]) -> DataFrame:
    """Rows of scored (claim, similarity, rank_score, chunk_pos) that reach the threshold; of a claim with none, its best row."""
    per = Window.partitionBy(*claim)
    marked = scored.withColumn("_any", F.max((F.col("similarity") >= threshold).cast("int")).over(per)).withColumn("_nth", F.row_number().over(per.orderBy(*best_first())))
    return marked.where((F.col("similarity") >= threshold) | ((F.col("_any") == 0) & (F.col("_nth") == 1))).drop("_any", "_nth")


def diverse_top_k(scored: DataFrame, top_k: int, claim: list[str], source: str = "filename") -> DataFrame:
    """Each claim's best row of every source, then the best others until there are top_k; evidence_rank is their order. With
    more sources than top_k there are more rows than top_k."""
    first = Window.partitionBy(*claim, source).orderBy(*best_first())
    marked = scored.withColumn("_own", F.row_number().over(first))
    per = Window.partitionBy(*claim)
    marked = marked.withColumn("_sources", F.sum((F.col("_own") == 1).cast("int")).over(per))
    marked = marked.withColumn("_fill", F.sum((F.col("_own") > 1).cast("int")).over(per.orderBy(*best_first()).rowsBetween(Window.unboundedPreceding, 0)))
    kept = marked.where((F.col("_own") == 1) | (F.col("_fill") <= F.greatest(F.lit(0), F.lit(top_k) - F.col("_sources"))))
    final = Window.partitionBy(*claim).orderBy(F.desc("rank_score"), F.desc("similarity"), F.asc(F.col("_own") > 1), F.asc("chunk_pos"))
    return kept.withColumn("evidence_rank", F.row_number().over(final)).drop("_own", "_sources", "_fill")


class Leading:
    """The pairs of a batch of passages and some claims that the operators above can choose: those that reach the threshold, of
    every source only the top_k + 1 best (one of its own and top_k that fill up) where top_k is given, and the best at all. A
    task has one, which remembers each claim's best scores, those of the sources up to HELD numbers. Batches have
    authority_weight and, with top_k, the source column."""

    #: What rounding of scores to four digits, and of similarities, may change in an order.
    SCORE_SLACK, SLACK = 2e-4, 1e-5
    HELD = 4_000_000

    def __init__(self, claims: int, threshold: float, top_k: int | None = None, source: str = "filename"):
        self.threshold, self.top_k, self.source = threshold, top_k, source
        self.best = np.full(claims, -np.inf)
        self.held: dict[str | None, np.ndarray] = {}

    def __call__(self, batch: pa.RecordBatch, near: np.ndarray, lo: int) -> np.ndarray:
        """A mask over near, the similarities of the batch's rows to the claims from lo on."""
        weight = batch.column("authority_weight").to_numpy(zero_copy_only=False).astype(float)
        score = np.clip(near, 0.0, 1.0) * (0.75 + 0.25 * np.clip(weight, 0.5, 1.0))[:, None]
        best = self.best[lo : lo + near.shape[1]]
        np.maximum(best, score.max(axis=0), out=best)
        passing = near >= self.threshold - self.SLACK
        if self.top_k is not None:
            sure = np.where(near >= self.threshold + self.SLACK, score, -np.inf)
            found, most = batch.column(self.source).dictionary_encode(), self.top_k + 1
            names, of = [*found.dictionary.to_pylist(), None], np.asarray(found.indices.fill_null(-1))
            by = np.argsort(of, kind="stable")
            edge = np.append(np.flatnonzero(np.append(True, of[by][1:] != of[by][:-1])), len(by))
            for a, b in zip(edge, edge[1:]):
                rows, name = by[a:b], names[of[by[a]]]
                if name not in self.held and (len(self.held) + 1) * most * len(self.best) <= self.HELD:
                    self.held[name] = np.full((most, len(self.best)), -np.inf)
                seen = sure[rows]
                if name in self.held:
                    seen = np.concatenate([self.held[name][:, lo : lo + near.shape[1]], seen])
                if len(seen) >= most:
                    top = np.partition(seen, len(seen) - most, axis=0)[len(seen) - most :]
                    passing[rows] &= score[rows] >= top[0] - self.SCORE_SLACK
                    if name in self.held:
                        self.held[name][:, lo : lo + near.shape[1]] = top
        return passing | (score >= best - self.SCORE_SLACK)


def retrieve(pairs: DataFrame, top_k: int = 3, threshold: float = 0.25, claim: list[str] | None = None, source: str = "filename", weighted: bool = True) -> DataFrame:
    """Evidence of every claim from scored pairs (claim columns, similarity, authority_weight, chunk_pos, source, ...)."""
    claim = claim or ["claim_id"]
    scored = pairs.withColumn("rank_score", ranking_score(F.col("similarity"), F.col("authority_weight"), weighted))
    return diverse_top_k(above_threshold(scored, threshold, claim), top_k, claim, source).withColumn("similarity", F.round("similarity", 4)).withColumn(
        "ranking_score", F.when((F.col("rank_score") == 0) & (F.col("similarity") != 0), F.col("similarity")).otherwise(F.col("rank_score"))
    ).drop("rank_score")


def with_unmatched(pairs: DataFrame, claims: DataFrame, chunks: DataFrame, claim: list[str]) -> DataFrame:
    """Adds, for claims that share nothing with any chunk, the pair with the first chunk at similarity 0, so that each claim has
    a candidate. claims has the claim columns; chunks what pairs say of chunks."""
    missing = claims.select(*claim).join(pairs.select(*claim).distinct(), claim, "left_anti")
    first = chunks.orderBy("chunk_pos").limit(1)
    alone = missing.join(F.broadcast(first)).withColumn("similarity", F.lit(0.0))
    return pairs.unionByName(alone.select(*pairs.columns))
