"""Model calls with deadlines, attempts and ordered providers."""

import threading
import time

import pytest

from evidence_engine.operators import model_policy
from evidence_engine.plans import demo, verify


def test_answers_in_time():
    lock, now, most = threading.Lock(), [0], [0]

    def call(prompt):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        try:
            if prompt == "stall":
                time.sleep(30)
            if prompt == "fail":
                raise OSError("no")
            time.sleep(0.02)
            return None if prompt == "nothing" else prompt.upper()
        finally:
            with lock:
                now[0] -= 1

    prompts = ["a", "fail", "stall", "b", "nothing", "stall", *"cdefghij"]
    began = time.monotonic()
    assert model_policy.in_time(call, prompts, 0.6, 4) == ["A", None, None, "B", None, None, *"CDEFGHIJ"]
    assert time.monotonic() - began < 5 and most[0] <= 4 + 2  # those that stall are left behind
    assert model_policy.in_time(call, [], 0.1) == []


def test_providers_in_order(spark):
    def first(prompt):
        if prompt.endswith("1"):
            raise OSError(prompt)
        if prompt == "p2":
            time.sleep(30)
        return None if prompt == "p3" else "first " + prompt

    def second(prompt):
        if prompt == "p11":
            raise OSError(prompt)
        return "second " + prompt

    df = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "id long, prompt string")
    got = {r["id"]: (r["raw"], r["provider"]) for r in model_policy.ask_providers(df, (first, second), ["id"], deadline=1.0, attempts=1).collect()}
    want = {i: (f"first p{i}", 0) for i in range(12)} | {i: (f"second p{i}", 1) for i in (1, 2, 3)} | {11: (None, None)}
    assert got == want


def test_attempts():
    seen = []

    def sometimes(prompt):
        seen.append(prompt)
        if len(seen) < 3:
            raise OSError(prompt)
        return "yes"

    assert model_policy.in_time(sometimes, ["x"], 1.0) == [None] and model_policy.in_time(sometimes, ["x"], 1.0) == [None] and model_policy.in_time(sometimes, ["x"], 1.0) == ["yes"]


@pytest.mark.parametrize("broken", [False, True])
def test_providers_judge_after_the_rules(spark, broken):
    def first(prompt):
        raise OSError("no connection")

    def second(prompt):
        if broken:
            raise OSError("neither")
        return '{"verdict": "SUPPORTED", "confidence": 0.7, "reason": "Said so.", "cited_evidence_ids": ["E001"]}'

    config = verify.Config(entailment="model", providers=(first, second), deadline=5.0)
    said = {r["text"]: r["outcome"] for r in verify.verify_files(*demo.package(spark), config=config).results.collect()}
    museum = "The harbour museum sells postcards of lighthouses."
    assert said[museum] == ("UNVERIFIED" if broken else "SUPPORTED") and said["The mooring fee is $90 per week for vessels under 12 metres."] == "REFUTED"


def test_stalls_hold_up_no_others(spark):
    """Ten batches with a prompt each that stalls: the others go on, and no thread is made for a prompt."""
    threads = spark.sparkContext.accumulator(0)

    def first(prompt):
        if threading.current_thread() not in seen:
            seen.add(threading.current_thread())
            threads.add(1)
        if int(prompt) % 100 == 7:
            time.sleep(30)
        return prompt

    seen = set()
    df = spark.range(1000).selectExpr("id", "string(id) prompt").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        began = time.monotonic()
        got = {r["id"]: (r["raw"], r["provider"]) for r in model_policy.ask_providers(df, (first, lambda p: "second " + p), ["id"], deadline=1.5, attempts=1, parallel=16).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert time.monotonic() - began < 10
    assert got == {i: (f"second {i}", 1) if i % 100 == 7 else (str(i), 0) for i in range(1000)}
