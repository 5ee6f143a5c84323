"""The whole verification as one plan: drafts and sources in, judged claims, summaries and certificates out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.functions import text
from evidence_engine.operators import claims as claim_ops
from evidence_engine.operators import entailment, inverted, model_policy, retrieval, rollup, similarity
from evidence_engine.plans.staging import cut
from evidence_engine.sources import ingest


EMBEDDINGS, ENTAILMENTS = ("tfidf", "dense"), ("rules", "model")


@dataclass(frozen=True)
class Config:
    """What a run may set. embedding "dense" takes vectors from the encoder (texts to vectors), and TF-IDF where there is none or
    it fails on a claim; entailment "model" has the model (prompts to answers) judge after the rules, which stand where there is
    none or it fails. Or there are providers (a prompt to its answer), asked one after the other, each prompt within a deadline."""

    top_k: int = 3
    threshold: float = 0.25
    authority_weighting: bool = True
    conflict_detection: bool = True
    embedding: str = "tfidf"
    entailment: str = "rules"
    encoder: Callable[[list[str]], object] | None = None
    model: Callable[[list[str]], list[str | None]] | None = None
    providers: tuple[Callable[[str], str | None], ...] = ()
    deadline: float = model_policy.DEADLINE

    def __post_init__(self) -> None:
        if self.embedding not in EMBEDDINGS or self.entailment not in ENTAILMENTS:
            raise ValueError(f"embedding is one of {EMBEDDINGS}, entailment one of {ENTAILMENTS}")

    def labels(self) -> dict[str, str]:
        return {k: str(getattr(self, k)) for k in ("top_k", "threshold", "authority_weighting", "conflict_detection", "embedding", "entailment")}


@dataclass
class Verification:
    """DataFrames of a verification, not yet computed."""

    sources: DataFrame
    chunks: DataFrame
    claims: DataFrame
    evidence: DataFrame
    judged: DataFrame
    results: DataFrame
    summary: DataFrame
    #: what scored the pairs in the end: dense or tfidf
    embedding: str = "tfidf"


#: Query terms (or numbers of vectors) that a scoring pass takes along, at most; more claims are scored in blocks.
BLOCK_TERMS = 2_000_000
#: Similarities that a task holds at once, and cells of a block's matrix; a block that has more cells is multiplied sparsely.
CELLS, MATRIX_CELLS = 2_000_000, 4_000_000


def sparse_pairs(claims: DataFrame, chunks: DataFrame, claim: str = "claim_key", chunk: str = "chunk_key") -> DataFrame:
    """(claim, chunk, similarity) of TF-IDF vectors whose idf is that of the chunks. claims and chunks have their key and text."""
    chunk_counts = similarity.term_counts(chunks, chunk)
    idf = similarity.inverse_frequencies(*similarity.counted_frequencies(chunks))
    a = similarity.weights(similarity.term_counts(claims, claim), idf, claim)
    b = similarity.weights(chunk_counts, idf, chunk)
    return similarity.cosines(a, b, claim, chunk)


def candidates(claims: DataFrame, chunks: DataFrame, config: Config, claim: str = "claim_key", chunk: str = "chunk_key", source: str = "filename") -> DataFrame:
    """The pairs of sparse_pairs() that retrieval can choose from, scored where the chunks are: an Arrow batch of chunks is indexed
    and searched for a block of claims, and only each claim's best rows of every source, top_k best rows and a task's best row at
    all leave the task. chunks has its key, text, chunk_pos, authority_weight and the source column.

    Claims are the query side: the terms of a block go to every task, and a block has about BLOCK_TERMS of them. Chunks are read
    once for a block, in one stage; only where there are more terms than a task can know, their weights come from a shuffle.
    """
    idf = similarity.inverse_frequencies(*similarity.counted_frequencies(chunks))
    vocabulary = similarity.vocabulary(idf, claims)
    if vocabulary is not None:
        asked = claims.select(claim, text.terms(F.col("text")).alias("terms"))
        total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
        rows = chunks.select(chunk, source, "chunk_pos", F.col("authority_weight").cast("double").alias("authority_weight"), *text.lowered(F.col("text")))
        return blockwise(asked, -(-total // BLOCK_TERMS), claim, lambda block: _by_index(rows, vocabulary, block, config, claim, chunk, source))
    wanted = similarity.weights(similarity.term_counts(claims, claim), idf, claim).groupBy(claim).agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    wanted = cut(wanted)
    total = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    # a chunk's norm takes all its terms, its product with claims only theirs
    weighted = similarity.weights(similarity.term_counts(chunks, chunk), idf, chunk)
    about = chunks.select(chunk, source, "chunk_pos", "authority_weight")
    return blockwise(wanted, -(-total // BLOCK_TERMS), claim, lambda block: _by_terms(weighted, about, block, config, claim, chunk, source))


def dense_candidates(claims: DataFrame, chunks: DataFrame, config: Config, claim: str = "claim_key", chunk: str = "chunk_key", source: str = "filename") -> DataFrame | None:
    """The same by the encoder's vectors; null if it has none for some claim. A chunk without vector is like no claim."""
    asked = cut(similarity.embedded(claims, claim, config.encoder))
    if not asked.where("vec is null").isEmpty():
        return None
    vectors = similarity.embedded(chunks, chunk, config.encoder)
    rows = chunks.select(chunk, source, "chunk_pos", "authority_weight").join(vectors, chunk)
    total = asked.agg(F.sum(F.size("vec"))).first()[0] or 0
    return blockwise(asked, -(-total // BLOCK_TERMS), claim, lambda block: _by_vectors(rows, block, config, claim, chunk, source))


def blockwise(claims: DataFrame, blocks: int, claim: str, scored: Callable[[list], DataFrame]) -> DataFrame:
    """The union of what scored gives for the rows of each of so many blocks of claims."""
    out = None
    for i in range(max(1, blocks)):
        part = scored(claims.where(F.pmod(F.xxhash64(claim), F.lit(max(1, blocks))) == i).collect())
        out = part if out is None else out.unionByName(part)
    return out


class Entries:
    """A block of claims as lists of (claim, weight) by term; its product with a chunk's terms sums over the lists."""

    def __init__(self, block: list, claim: str):
        self.keys = [r[claim] for r in block]
        self.place: dict[str, int] = {}
        term, of, weight = [], [], []
        for j, r in enumerate(block):
            w = np.array([float(t["weight"]) for t in r["terms"]])
            length = float(np.sqrt((w * w).sum()))
            term += [self.place.setdefault(t["term"], len(self.place)) for t in r["terms"]]
            of += [j] * len(w)
            weight += (w / (length if length > 1e-6 else 1.0)).tolist()
        by = np.argsort(np.array(term, dtype=np.int64), kind="stable")
        self.of, self.weight = np.array(of, dtype=np.int64)[by], np.array(weight)[by]
        self.first = np.searchsorted(np.array(term, dtype=np.int64)[by], np.arange(len(self.place) + 1))

    def similarities(self, codes: list, weights: list, dense: bool) -> np.ndarray:
        """Rows of products for chunks given by their terms' codes and weights."""
        if dense:
            matrix = self.matrix()
            return np.stack([w @ matrix[c] for c, w in zip(codes, weights)])
        n = len(self.keys)
        out = np.zeros((len(codes), n))
        for k, (c, w) in enumerate(zip(codes, weights)):
            size = self.first[c + 1] - self.first[c]
            at = np.repeat(self.first[c] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            out[k] = np.bincount(self.of[at], weights=self.weight[at] * np.repeat(w, size), minlength=n)
        return out

    def matrix(self) -> np.ndarray:
        if not hasattr(self, "_matrix"):
            self._matrix = np.zeros((len(self.place), len(self.keys)))
            self._matrix[np.repeat(np.arange(len(self.place)), np.diff(self.first)), self.of] = self.weight
        return self._matrix


def _by_terms(weighted: DataFrame, about: DataFrame, block: list, config: Config, claim: str, chunk: str, source: str) -> DataFrame:
    entries = Entries(block, claim)
    dense = len(entries.place) * len(entries.keys) <= MATRIX_CELLS
    codes = about.sparkSession.createDataFrame(list(entries.place.items()), "term string, code int")
    square = (F.col("weight") * F.col("weight")).cast("decimal(28,9)")
    known = F.col("code").isNotNull()
    marked = weighted.join(F.broadcast(codes), "term", "left").groupBy(chunk).agg(
        F.sqrt(F.sum(square).cast("double")).alias("norm"), F.collect_list("code").alias("codes"), F.collect_list(F.when(known, F.col("weight").cast("double"))).alias("weights")
    )

    def product(batch: pa.RecordBatch) -> np.ndarray:
        norm = batch.column("norm").to_numpy()
        codes, weights = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("codes", "weights"))
        return entries.similarities(codes, weights, dense) / np.where(norm > 1e-6, norm, 1.0)[:, None]

    return picked(about.join(marked.where(F.size("codes") > 0), chunk), entries.keys, lambda: of_products(product, len(entries.keys)), config, claim, chunk, source)


def _by_vectors(rows: DataFrame, block: list, config: Config, claim: str, chunk: str, source: str) -> DataFrame:
    asked = similarity.unit_rows([r["vec"] for r in block])

    def product(batch: pa.RecordBatch) -> np.ndarray:
        found = similarity.unit_rows(batch.column("vec").to_pylist())
        width = min(found.shape[1], asked.shape[1])
        return found[:, :width] @ asked[:, :width].T

    return picked(rows, [r[claim] for r in block], lambda: of_products(product, len(block)), config, claim, chunk, source)


def _by_index(rows: DataFrame, vocabulary: Broadcast, block: list, config: Config, claim: str, chunk: str, source: str) -> DataFrame:
    lists = [list(r["terms"] or []) for r in block]

    def search() -> Callable[[pa.RecordBatch, np.ndarray], tuple]:
        asked = inverted.Claims(lists, vocabulary.value)
        return lambda batch, bound: inverted.Segment(text.batch_terms(batch), vocabulary.value, asked).reaching(bound)

    return picked(rows, [r[claim] for r in block], search, config, claim, chunk, source)


def of_products(product: Callable[[pa.RecordBatch], np.ndarray], n: int) -> Callable[[pa.RecordBatch, np.ndarray], tuple]:
    """A search (see picked) by a function that multiplies the rows of a batch with all n claims."""

    def search(batch: pa.RecordBatch, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        step, out = max(1, CELLS // max(1, n)), []
        for lo in range(0, batch.num_rows, step):
            found = np.round(product(batch.slice(lo, step)), 9)
            row, which = np.nonzero((found > 0) & (found >= bound))
            out.append((row + lo, which, found[row, which]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    return search


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Which rows of sorted keys differ from the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def picked(rows: DataFrame, keys: list, search: Callable[[], Callable], config: Config, claim: str, chunk: str, source: str) -> DataFrame:
    """What retrieval could take of rows for a block of claims: of those that reach the threshold the best of every source and
    top_k more, and a task's best at all. search makes, in a task, the function that gives (row, claim, similarity) of a batch for
    all pairs above 0 that reach the bound of their claim."""
    kinds, names, by_terms = dict(rows.dtypes), [chunk, source, "chunk_pos", "authority_weight"], "_low" in rows.columns
    kind = "string" if not keys or isinstance(keys[0], str) else "long"
    schema = f"`{claim}` {kind}, `{chunk}` {kinds[chunk]}, `{source}` {kinds[source]}, chunk_pos {kinds['chunk_pos']}, authority_weight double, similarity double"
    of_key = pa.string() if kind == "string" else pa.int64()

    def out(which: np.ndarray, columns: list, sim: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([keys[j] for j in which], of_key), *columns, pa.array(sim, pa.float64())], [claim, *names, "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found, types = len(keys), search(), []
        score_of, sim_of, pos_of = np.full(n, -np.inf), np.full(n, -np.inf), np.full(n, np.inf)
        best: list[list] = [[None] * n for _ in names]
        passed = np.zeros(n, bool)
        for batch in text.slices(batches) if by_terms else batches:
            types = [batch.column(c).type for c in names]
            # a row counts if it reaches the threshold, or, while no row has, the best score so far (of four digits)
            bound = np.where(passed, config.threshold, np.minimum(config.threshold, score_of - 1e-4))
            row, which, sim = found(batch, bound)
            weight = batch.column("authority_weight").to_numpy(zero_copy_only=False).astype(float)
            boost = 0.75 + 0.25 * np.clip(weight, 0.5, 1.0) if config.authority_weighting else np.ones(batch.num_rows)
            score, pos = np.round(sim * boost[row], 4), batch.column("chunk_pos").to_numpy(zero_copy_only=False)[row]
            by = np.lexsort((pos, -sim, -score, which))
            row, which, sim, score, pos = row[by], which[by], sim[by], score[by], pos[by]
            # the best at all: by score, similarity, position
            top = np.flatnonzero(firsts(which)) if len(which) else np.zeros(0, np.int64)
            j = which[top]
            better = (score[top] > score_of[j]) | (score[top] == score_of[j]) & ((sim[top] > sim_of[j]) | (sim[top] == sim_of[j]) & (pos[top] < pos_of[j]))
            top, j = top[better], j[better]
            score_of[j], sim_of[j], pos_of[j] = score[top], sim[top], pos[top]
            for i, c in enumerate(names):
                for k, v in zip(j, batch.column(c).take(pa.array(row[top])).to_pylist()):
                    best[i][k] = v
            # those that reach the threshold
            high = sim >= config.threshold
            row, which, sim = row[high], which[high], sim[high]
            if len(row):
                passed[which] = True
                of = np.asarray(batch.column(source).dictionary_encode().indices.fill_null(-1))[row]
                nth = np.arange(len(which)) - np.maximum.accumulate(np.where(firsts(which), np.arange(len(which)), 0))
                by = np.lexsort((nth, of, which))
                own = np.zeros(len(which), bool)
                own[by] = firsts(which[by], of[by])
                keep = own | (nth < config.top_k + np.bincount(which, own, n)[which])
                yield out(which[keep], [batch.column(c).take(pa.array(row[keep])) for c in names], sim[keep])
        # those that reach the threshold have left already
        alone = np.flatnonzero((sim_of > 0) & (sim_of < config.threshold) & ~passed)
        if len(alone):
            yield out(alone, [pa.array([values[j] for j in alone], t) for values, t in zip(best, types)], sim_of[alone])

    return rows.mapInArrow(run, schema)


def with_model(results: DataFrame, config: Config) -> DataFrame:
    """Results with what the model says of each claim and its first passages, where the policy lets it."""
    passages = F.coalesce("evidence", F.array().cast(dict(results.dtypes)["evidence"]))
    asked = results.select("claim_key", model_policy.prompt(F.col("text"), passages).alias("prompt"))
    told = model_policy.ask_providers(asked, config.providers, ["claim_key"], config.deadline) if config.providers else model_policy.ask(asked, config.model, ["claim_key"])
    said = told.select("claim_key", "raw")
    given = F.transform(F.slice(passages, 1, model_policy.PASSAGES), lambda p, i: F.format_string("E%03d", i + 1))
    both = results.join(cut(said), "claim_key", "left")
    answer = F.when(F.col("raw").isNotNull(), model_policy.validated(model_policy.answer(F.col("raw")), given))
    rules = F.struct("outcome", "confidence", "reason", "conflict_detected")
    return both.withColumn("_said", model_policy.combined(rules, answer)).withColumns({c: F.col(f"_said.{c}") for c in ("outcome", "confidence", "reason")}).drop("_said", "raw")


def verify(claims: DataFrame, chunks: DataFrame, pairs: DataFrame, config: Config = Config(), sources: DataFrame | None = None) -> Verification:
    """Judges claims on the evidence that the scored pairs give.

    claims: run_id, claim_key, claim_id, claim_pos, text. chunks: chunk_key, chunk_pos, chunk_id, source_id, filename, location,
    page, text, authority_level, authority_weight. pairs: claim_key, chunk_key, similarity. Quantities and words are taken from
    each claim and each chosen chunk once, before the two meet.
    """
    key = ["claim_key"]
    # scores and evidence are used several times below, so they are computed once
    pairs = cut(pairs.select("claim_key", "chunk_key", "similarity"))
    chosen = pairs.join(chunks.drop("text"), "chunk_key")
    chosen = retrieval.with_unmatched(chosen, claims, chunks.drop("text").select(*[c for c in chosen.columns if c not in ("claim_key", "similarity")]), key)
    evidence = cut(retrieval.retrieve(chosen, config.top_k, config.threshold, key, "filename", config.authority_weighting))
    used = chunks.select("chunk_key", "text").join(evidence.select("chunk_key").distinct(), "chunk_key", "left_semi")
    left = entailment.features(claims.select("claim_key", F.col("text").alias("claim_text")), "claim_text", "claim")
    right = entailment.features(used, "text", "passage")
    both = entailment.relevant(evidence).join(left, "claim_key").join(right, "chunk_key")
    judged = entailment.judge(both)
    plain = judged.drop(*[c for c in judged.columns if c.startswith(("claim_", "passage_")) and c != "claim_key"])
    outcomes = entailment.claim_outcomes(plain, key, config.conflict_detection)
    results = claims.join(outcomes, "claim_key", "left").withColumns(
        {
            "outcome": F.coalesce("outcome", F.lit(entailment.UNVERIFIED)),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
            "reason": F.coalesce("reason", F.lit(entailment.NO_TEXT)),
            "conflict_detected": F.coalesce("conflict_detected", F.lit(False)),
        }
    )
    if config.entailment == "model" and (config.model or config.providers):
        results = with_model(results, config)
    return Verification(sources, chunks, claims, evidence, judged, results, rollup.summary(results, ["run_id"]))


def scored_pairs(claims: DataFrame, chunks: DataFrame, config: Config) -> tuple[DataFrame, str]:
    """Pairs that retrieval can choose from, and what scored them."""
    if config.embedding == "dense" and config.encoder:
        pairs = dense_candidates(claims, chunks, config)
        if pairs is not None:
            return pairs, "dense"
    return candidates(claims, chunks, config), "tfidf"


def verify_files(drafts: DataFrame, files: DataFrame, authorities: DataFrame | None = None, config: Config = Config()) -> Verification:
    """Verifies drafts (run_id, draft) against all files (filename, content)."""
    parsed = ingest.parse(files)
    passages = ingest.authorized(ingest.passages(parsed), authorities)
    chunks = passages.withColumn("chunk_key", F.concat_ws("/", "filename", "chunk_id", F.col("chunk_pos").cast("string")))
    claims = claim_ops.from_drafts(drafts, "run_id").withColumn("claim_key", F.concat_ws("/", F.col("run_id").cast("string"), "claim_id"))
    pairs, scored_by = scored_pairs(claims.select("claim_key", "text"), chunks, config)
    sources = ingest.authorized(ingest.sources(parsed), authorities)
    found = verify(claims, chunks, pairs, config, sources)
    found.embedding = scored_by
    return found
