"""Spans of patterns in texts and the sweep over them, against plain Python; one long text in linear time."""

import random
import re
import time

from pyspark.sql import functions as F

from evidence_engine.functions import quantities


def test_running(spark, monkeypatch):
    monkeypatch.setattr(quantities, "RUN", 3)
    rng = random.Random(1)
    rows = [(i, [rng.randint(0, 9) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 4, 7, 9, 10, 40])]
    df = spark.createDataFrame(rows, "id int, xs array<int>")
    got = df.orderBy("id").select(quantities.running(F.col("xs"), F.lit(0), lambda at, x: at + x).alias("sum"), quantities.running(F.col("xs"), F.lit(0), lambda at, x: F.greatest(at, x)).alias("most")).collect()
    for (_, xs), r in zip(rows, got):
        assert r["sum"] == [sum(xs[: i + 1]) for i in range(len(xs))] and r["most"] == [max(xs[: i + 1]) for i in range(len(xs))]


def test_spans_and_their_sides(spark):
    rng = random.Random(2)
    bits = ["12", "7 ", "x", "é🙂", " ", "\n", "abc" * 30, "5 5 5 5 5", "a1b2c3", ""]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(120)] + ["", "12", "no number", "1 " * 200, "x" * 300 + "1" + "y" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").orderBy("id").select(quantities.spans(F.col("t"), F.lit(r"\b\d+\b")).alias("s")).collect()
    for t, r in zip(texts, rows):
        want = [(m[0], m.start(), m.end(), t[max(0, m.start() - 50) : m.start()], t[m.end() : m.end() + 50]) for m in re.finditer(r"\b\d+\b", t)]
        assert [tuple(x) for x in r["s"]] == want


def test_outside(spark):
    rng = random.Random(3)
    cases = []
    for i in range(60):
        draw = lambda n, most: sorted({(b := rng.randrange(60), b + rng.randint(1, most)) for _ in range(rng.randint(0, n))})
        found = {b: (b, e) for b, e in draw(12, 3)}
        taken = draw(6, 8)
        rng.shuffle(taken)
        cases.append((i, sorted(found.values()), taken))
    df = spark.createDataFrame(cases, "id int, f array<struct<begin:int,end:int>>, t array<struct<begin:int,end:int>>")
    got = df.orderBy("id").select(quantities.outside(F.col("f"), F.col("t")).alias("x")).collect()
    assert [[tuple(x) for x in r["x"]] for r in got] == [[x for x in f if not any(b <= x[0] < e for b, e in t)] for _, f, t in cases]


def test_time_is_linear_in_the_quantities(spark):
    """Eight times the quantities take less than sixteen times the time, what planning takes left out."""

    def seconds(n):
        text = " and ".join(f"has {i} pieces on 3 May" if i % 4 == 0 else f"up to {i} days" for i in range(n))
        df = spark.createDataFrame([(text,)], "t string").select(F.size(quantities.quantities("t")).alias("n"))
        began = time.perf_counter()
        assert df.first()["n"] == n + 2 * ((n + 3) // 4)  # a day of a date counts by itself too: the space before it is not the date's
        return time.perf_counter() - began

    seconds(10)
    fixed, some, many = seconds(10), seconds(2_000), seconds(16_000)
    assert many - fixed < 16 * max(some - fixed, 0.5)
