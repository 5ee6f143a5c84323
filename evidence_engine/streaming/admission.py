"""Admission by a sliding log: so many accepted requests of a client within a window; rejected ones are not counted.

For a bounded table, for a stream in the order in which it arrives, and for a stream in the order of its times.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

LIMIT, WINDOW = 10, 60.0
OUTPUT = "client string, ts timestamp, allowed boolean, retry_after long"


def admit(log: list[float], now: float, limit: int, window: float) -> tuple[list[float], bool, int]:
    """The log after a request, whether it is accepted, and else after how many seconds to try again."""
    log = [t for t in log if t > now - window]
    if len(log) >= limit:
        return log, False, max(1, int(log[0] + window - now))
    return [*log, now], True, 0


def admissions(requests: DataFrame, limit: int = LIMIT, window: float = WINDOW) -> DataFrame:
    """client, ts, allowed and retry_after of a bounded table of requests (client, ts, and seq where times tie). A row whose
    column reset is true is no request: the client's log begins anew. A task reads its clients' requests in order and keeps
    nothing but the ``limit`` times of the client it is at."""
    own = lambda c, other: (F.col(c) if c in requests.columns else F.lit(other)).alias(c)
    rows = requests.select("client", F.col("ts").cast("timestamp").alias("ts"), own("seq", 0), F.coalesce(own("reset", False), F.lit(False)).alias("reset"))
    ordered = rows.repartition("client").sortWithinPartitions("client", "ts", "seq").select("client", "ts", (F.unix_micros("ts") / 1e6).alias("now"), "reset")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, log = None, []
        for batch in batches:
            allowed, wait = [], []
            for client, now, reset in zip(batch["client"], batch["now"], batch["reset"]):
                if client != at or reset:
                    at, log = client, []
                if reset:
                    continue
                log, ok, seconds = admit(log, now, limit, window)
                allowed.append(ok)
                wait.append(seconds)
            kept = batch[~batch["reset"]]
            yield pd.DataFrame({"client": kept["client"].to_numpy(), "ts": kept["ts"].to_numpy(), "allowed": allowed, "retry_after": wait})

    return ordered.mapInPandas(run, OUTPUT)


class Log(StatefulProcessor):
    """Keeps the accepted times of a client; state of idle clients expires."""

    def __init__(self, limit: int = LIMIT, window: float = WINDOW, ttl_ms: int | None = None):
        self.limit, self.window, self.ttl_ms = limit, window, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("at", DoubleType())])
        self.log = handle.getListState("log", schema, self.ttl_ms) if self.ttl_ms else handle.getListState("log", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted((t, bool(r)) for batch in rows for t, r in zip(batch["ts"], batch.get("reset", [False] * len(batch))))
        log = [x[0] for x in self.log.get()] if self.log.exists() else []
        out = []
        for ts, reset in times:
            if reset:
                log = []
                continue
            log, ok, wait = admit(log, ts.timestamp(), self.limit, self.window)
            out.append((key[0], ts, ok, wait))
        self.log.put([(t,) for t in log])
        yield pd.DataFrame(out, columns=["client", "ts", "allowed", "retry_after"])

    def close(self) -> None:
        pass


def admission_stream(requests: DataFrame, limit: int = LIMIT, window: float = WINDOW, ttl_ms: int | None = None) -> DataFrame:
    """The same of a stream of requests (client, ts, and reset if there is one); needs a state store that transformWithState supports."""
    return requests.groupBy("client").transformWithStateInPandas(statefulProcessor=Log(limit, window, ttl_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


class OrderedLog(StatefulProcessor):
    """Decides the requests of a client in the order of their times, however they arrive: a request waits until the watermark has
    passed its time, and one timer of event time wakes the client for the earliest that waits. A client with no waiting request
    and no accepted one within the window has no state any more."""

    def __init__(self, limit: int = LIMIT, window: float = WINDOW):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", StructType([StructField("at", DoubleType())]))
        self.waiting = handle.getListState("waiting", StructType([StructField("micros", LongType()), StructField("seq", LongType()), StructField("reset", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(m), int(s), bool(r)) for batch in rows for m, s, r in zip(batch["micros"], batch["seq"], batch["reset"])]
        self.waiting.put(new + [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else new)
        self.wake(min(x[0] for x in new), timerValues)
        return iter(())

    def wake(self, micros: int, timerValues) -> None:
        """Sets the timer to a time, if none is earlier; a timer that the watermark has passed is running out just now."""
        at, timers = micros // 1000 + 1, [t for t in self.handle.listTimers() if t > timerValues.getCurrentWatermarkInMs()]
        if not timers or min(timers) > at:
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        due, later = [x for x in waiting if x[0] < passed], [x for x in waiting if x[0] >= passed]
        log, out = [x[0] for x in self.log.get()] if self.log.exists() else [], []
        for micros, _, reset in due:
            if reset:
                log = []
                continue
            log, ok, wait = admit(log, micros / 1e6, self.limit, self.window)
            out.append((key[0], pd.Timestamp(micros, unit="us"), ok, wait))
        log = [t for t in log if t + self.window > passed / 1e6]
        for state, left in ((self.log, [(t,) for t in log]), (self.waiting, later)):
            state.put(left) if left else state.clear()
        if later or log:
            self.wake(later[0][0] if later else int((log[-1] + self.window) * 1e6), timerValues)
        if out:
            yield pd.DataFrame(out, columns=["client", "ts", "allowed", "retry_after"])

    def close(self) -> None:
        pass


def ordered_admission_stream(requests: DataFrame, late: str, limit: int = LIMIT, window: float = WINDOW) -> DataFrame:
    """admissions() of a stream of requests (client, ts, and seq and reset where there are any) that may arrive in any order, but
    no later than ``late`` (an interval) behind the latest. What comes later than that is left out. A request is decided once the
    watermark has passed it. Needs a state store that transformWithState supports."""
    own = lambda c, other: (F.col(c) if c in requests.columns else F.lit(other)).alias(c)
    rows = requests.select("client", "ts", own("seq", 0), F.coalesce(own("reset", False), F.lit(False)).alias("reset")).withColumn("micros", F.unix_micros("ts")).withWatermark("ts", late)
    return rows.groupBy("client").transformWithStateInPandas(statefulProcessor=OrderedLog(limit, window), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
