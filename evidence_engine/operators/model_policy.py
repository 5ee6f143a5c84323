"""What a language model may say about a claim: its answers are parsed, validated and held against the rules' outcome.

The model is a callable that the caller brings, from prompts to answers; without one the rules decide alone.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SECRETS = ("system_prompt", "system prompt", "api_key", "bearer ", "sk-")
PLAIN_REASON = "Evaluated according to evidence grounding rules."
UNCITED = "Unverified: Grounding evidence could not be confirmed with valid evidence ID."
UNPARSED = "Failed to parse model output."
ANSWER = "verdict string, confidence string, reason string, cited_evidence_ids string"
PASSAGES = 3
#: Seconds that a prompt may take, how often a provider is asked, and prompts that a task has under way at once.
DEADLINE, ATTEMPTS, PARALLEL = 12.0, 2, 8


def answer(raw: Column) -> Column:
    """The JSON object in a response as a struct; a default one where there is none."""
    found = F.from_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), ANSWER)
    default = F.struct(F.lit("UNVERIFIED").alias("verdict"), F.lit("0.0").alias("confidence"), F.lit(UNPARSED).alias("reason"), F.lit("[]").alias("cited_evidence_ids"))
    empty = F.coalesce(found["verdict"], found["confidence"], found["reason"], found["cited_evidence_ids"]).isNull()
    return F.when(empty, default).otherwise(found)


def validated(parsed: Column, valid_ids: Column) -> Column:
    """(outcome, confidence, reason) of an answer: confidence within 0 and 1, no markup or secrets in the reason, and support
    only with a passage that was given."""
    said = F.upper(F.trim(F.coalesce(parsed["verdict"], F.lit(""))))
    number = F.when(parsed["confidence"].isNull(), F.lit(0.8)).otherwise(F.coalesce(parsed["confidence"].try_cast("double"), F.lit(0.5)))
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)), 2)
    plain = F.regexp_replace(F.trim(F.coalesce(parsed["reason"], F.lit(""))), r"<[^>]+>", "")
    leaks = F.exists(F.array(*[F.lit(s) for s in SECRETS]), lambda s: F.contains(F.lower(plain), s))
    reason = F.when(leaks, PLAIN_REASON).otherwise(plain)
    cited = F.coalesce(F.from_json(parsed["cited_evidence_ids"], "array<string>"), F.array(parsed["cited_evidence_ids"]))
    uncited = (said == "SUPPORTED") & (F.size(valid_ids) > 0) & ~F.coalesce(F.arrays_overlap(cited, valid_ids), F.lit(False))
    result = lambda o, c, r: F.struct(o.alias("outcome"), c.alias("confidence"), r.alias("reason"))
    outcome = F.when(said.isin("SUPPORTED", "REFUTED"), said).otherwise("UNVERIFIED")
    return F.when(uncited, result(F.lit("UNVERIFIED"), F.lit(0.3), F.lit(UNCITED))).otherwise(result(outcome, confidence, reason))


def combined(rules: Column, model: Column) -> Column:
    """The model's result, but for conflicts, contradictions that the rules found, and support for what they refuted."""
    refuted = rules["outcome"] == "REFUTED"
    decided = F.contains(F.lower(rules["reason"]), F.lit("contradiction"))
    keep = rules["conflict_detected"] | model.isNull() | (refuted & (decided | (model["outcome"] == "SUPPORTED")))
    own = F.struct(rules["outcome"].alias("outcome"), rules["confidence"].alias("confidence"), rules["reason"].alias("reason"))
    return F.when(keep, own).otherwise(model)


def prompt(claim: Column, passages: Column) -> Column:
    """The claim and its first passages, numbered, as data between tags."""
    numbered = F.transform(F.slice(passages, 1, PASSAGES), lambda p, i: F.concat(F.format_string('<EVIDENCE id="E%03d" source="', i + 1), p["filename"], F.lit('">\n'), p["text"], F.lit("\n</EVIDENCE>")))
    return F.concat(F.lit("<EVIDENCE_SET>\n"), F.array_join(numbered, "\n"), F.lit("\n</EVIDENCE_SET>\n\n<CLAIM>\n"), claim, F.lit("\n</CLAIM>"))


def ask(claims: DataFrame, model: Callable[[list[str]], list[str | None]], run: list[str]) -> DataFrame:
    """Adds raw, the model's answer to the claim's prompt, an Arrow batch at a time; where a batch fails, prompt by prompt. Null
    where a prompt failed alone, for the rules to decide. claims has the run columns and prompt."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in claims.schema.fields) + ", raw string"

    def alone(prompt: str) -> str | None:
        try:
            return model([prompt])[0]
        except Exception:  # whatever a client raises: the rules' outcome stands
            return None

    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                raw = model(batch["prompt"].tolist())
            except Exception:
                raw = [alone(x) for x in batch["prompt"]]
            yield batch.assign(raw=raw)

    return claims.mapInPandas(answers, schema)


class _Slot:
    """A thread that asks one prompt after the other; job and since say what it is about."""

    def __init__(self, jobs: queue.SimpleQueue, done: queue.SimpleQueue, deadline: float):
        self.job, self.since, self.left_behind, self.lock = None, 0.0, False, threading.Lock()
        threading.Thread(target=self._work, args=(jobs, done, deadline), daemon=True).start()

    def _work(self, jobs: queue.SimpleQueue, done: queue.SimpleQueue, deadline: float) -> None:
        while (job := jobs.get()) is not None:
            number, prompt, step, call = job
            self.since = time.monotonic()
            self.job = job
            try:
                said = call(prompt)
            except Exception:  # whatever a client raises: that prompt alone is without answer
                said = None
            with self.lock:
                if self.left_behind:
                    return
                self.job = None
            done.put((number, prompt, step, said if time.monotonic() - self.since <= deadline else None))


class Callers:
    """Prompts that are asked of providers in order, so many at once, each call within the deadline. A thread whose call stalls is
    left behind, and another takes its place; it ends with the call or the worker, and its answer is not waited for."""

    def __init__(self, providers: Sequence[Callable[[str], str | None]], deadline: float, attempts: int, parallel: int):
        self.providers, self.deadline, self.attempts, self.parallel = providers, deadline, attempts, parallel
        self.jobs, self.done = queue.SimpleQueue(), queue.SimpleQueue()
        self.slots: list[_Slot] = []
        self.open = 0

    def ask(self, number: int, prompt: str, step: int = 0) -> None:
        """Puts a prompt in line; step counts the calls made for it before."""
        self.open += step == 0
        if step >= len(self.providers) * self.attempts:
            self.done.put((number, prompt, step, None))
            return
        self.jobs.put((number, prompt, step, self.providers[step // self.attempts]))
        if len(self.slots) < self.parallel:
            self.slots.append(_Slot(self.jobs, self.done, self.deadline))

    def answered(self, left: int = 0) -> dict[int, tuple[str | None, int | None]]:
        """Answers by number, with the provider's place, until no more than so many prompts are open."""
        found: dict[int, tuple[str | None, int | None]] = {}
        while self.open > left:
            try:
                number, prompt, step, said = self.done.get(timeout=self.deadline / 10)
            except queue.Empty:
                self._leave_stalled()
                continue
            if said is None and step + 1 < len(self.providers) * self.attempts:
                self.ask(number, prompt, step + 1)
            else:
                found[number] = (said, None if said is None else step // self.attempts)
                self.open -= 1
                if not len(found) % 1000:
                    self._leave_stalled()
        return found

    def _leave_stalled(self) -> None:
        for k, slot in enumerate(self.slots):
            with slot.lock:
                job = slot.job
                slot.left_behind = job is not None and time.monotonic() - slot.since > self.deadline
            if slot.left_behind:
                self.done.put((*job[:3], None))
                self.slots[k] = _Slot(self.jobs, self.done, self.deadline)

    def close(self) -> None:
        for _ in self.slots:
            self.jobs.put(None)


def in_time(call: Callable[[str], str | None], prompts: list[str], deadline: float = DEADLINE, parallel: int = PARALLEL) -> list[str | None]:
    """What call says of each prompt, so many under way at once; null where it fails or is not done by the deadline."""
    callers = Callers([call], deadline, 1, parallel)
    for i, prompt in enumerate(prompts):
        callers.ask(i, prompt)
    found = callers.answered()
    callers.close()
    return [found[i][0] for i in range(len(prompts))]


def ask_providers(claims: DataFrame, providers: Sequence[Callable[[str], str | None]], run: list[str], deadline: float = DEADLINE, attempts: int = ATTEMPTS, parallel: int = PARALLEL) -> DataFrame:
    """Adds raw and provider to claims (the run columns, prompt): the answer of the first provider, in their order, that gives one
    within the deadline, and its place in the order. A provider is asked so often for what it fails on before the next one is.
    Null where all fail, for the rules to decide. A prompt that is asked takes providers times attempts times deadline at most.
    Prompts that stall hold up no others: what is open at a batch's end, parallel rows at most, comes with a later one."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in claims.schema.fields) + ", raw string, provider int"

    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        callers, waiting, first = Callers(providers, deadline, attempts, parallel), None, 0

        def told(left: int) -> pd.DataFrame:
            nonlocal waiting
            found = callers.answered(left)
            ready = waiting.index.isin(list(found))
            rows, waiting = waiting[ready], waiting[~ready]
            raw, by = zip(*(found[i] for i in rows.index)) if len(rows) else ((), ())
            return rows.assign(raw=pd.Series(raw, rows.index, dtype=object), provider=pd.Series(by, rows.index, dtype="Int32"))

        try:
            for batch in batches:
                batch.index = range(first, first + len(batch))
                first += len(batch)
                for i, prompt in zip(batch.index, batch["prompt"].tolist()):
                    callers.ask(i, prompt)
                waiting = batch if waiting is None or not len(waiting) else pd.concat([waiting, batch])
                yield told(parallel)
            if waiting is not None:
                yield told(0)
        finally:
            callers.close()

    return claims.mapInPandas(answers, schema)
