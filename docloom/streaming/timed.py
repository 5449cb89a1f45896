"""State with time: a shared cache, deadlines and cancellation over streams, and the same as tables.

The stateful operators need a state store of RocksDB: `with_state_store` sets it. Time is the events' own; what is late for the
watermark is gone before it gets here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docloom.operators.ordered import CACHE_ANSWER, Cache, cache_answers

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Seconds until a model's answer, an inspection and a client's request are given up.
AI_SECONDS, INSPECTION_SECONDS, CLIENT_SECONDS = 28, 120, 60


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


class CacheProcessor(StatefulProcessor):
    """`Cache` in state: its entries and its jobs are maps, the generation and the order of use one value. Timers drop entries and
    jobs that have expired, so that a scope nobody asks keeps nothing."""

    def __init__(self, max_entries: int, max_weight: int, ttl_us: int, job_us: int):
        self.limits = (max_entries, max_weight, ttl_us, job_us)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.generation = handle.getValueState("generation", "n bigint")
        self.held = handle.getMapState("held", "key string", "place bigint, expiry bigint, weight bigint")
        self.jobs = handle.getMapState("jobs", "owner bigint", "key string, name string, generation bigint, since bigint, users string, open boolean, stored boolean")

    def load(self) -> Cache:
        c = Cache(*self.limits)
        if self.generation.exists():
            c.generation = self.generation.get()[0]
        entries = sorted((v[0], k[0], v[1], v[2]) for k, v in self.held.iterator())
        c.held = {k: (expiry, weight) for _, k, expiry, weight in entries}
        found = sorted((k[0], v) for k, v in self.jobs.iterator())
        c.jobs = {o: {"key": v[0], "name": v[1], "generation": v[2], "since": v[3], "users": [int(u) for u in v[4].split()], "open": v[5], "stored": v[6]} for o, v in found}
        return c

    def save(self, c: Cache) -> None:
        self.generation.update((c.generation,))
        for old, now in ((self.held, c.held), (self.jobs, c.jobs)):
            for (k,) in list(old.keys()):
                if k not in now:
                    old.removeKey((k,))
        for place, (k, (expiry, weight)) in enumerate(c.held.items()):
            self.held.updateValue((k,), (place, expiry, weight))
            self.handle.registerTimer(expiry // 1000 + 1)
        for o, j in c.jobs.items():
            self.jobs.updateValue((o,), (j["key"], j["name"], j["generation"], j["since"], " ".join(map(str, j["users"])), j["open"], j["stored"]))
            self.handle.registerTimer((j["since"] + self.limits[3]) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c = self.load()
        pdf = pd.concat(list(rows)).sort_values(["ts_us", "pos"])
        out = cache_answers(c, pdf)
        self.save(c)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        c = self.load()
        c.prune(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self.save(c)
        return iter([])

    def close(self) -> None:
        pass


def cache_stream(events: DataFrame, late: str = "1 minute", max_entries: int = 8, max_weight: int = 1_000_000, ttl_us: int = 600_000_000, job_us: int = 120_000_000) -> DataFrame:
    """CACHE_ANSWER of a stream of CACHE_EVENT; `operators.ordered.cache_trace` gives the same rows of a table.

    Within a micro-batch a scope's events are taken by time and pos; one that comes in a later micro-batch is taken
    then. A scope's part of a micro-batch is held at once: bound it by the trigger's input."""
    timed = events.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", late)
    return timed.groupBy("scope").transformWithStateInPandas(CacheProcessor(max_entries, max_weight, ttl_us, job_us), CACHE_ANSWER, "Append", "EventTime")


class DeadlineProcessor(StatefulProcessor):
    """One request: its end, and what came before it. A timer at the end says that nothing came."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.request = handle.getValueState("request", "asked bigint, until bigint, early bigint, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked, until, early, closed = self.request.get() if self.request.exists() else (None, None, None, False)
        out = []
        for e in pd.concat(list(rows)).itertuples(index=False):
            t = int(e.ts_us)
            if e.kind == "request" and asked is None:
                asked, until = t, t + int(e.limit_us)
                self.handle.registerTimer(until // 1000 + 1)
            elif e.kind == "answer":
                early = t if early is None else min(early, t)
        if asked is not None and not closed and early is not None and early < until:
            out, closed = [(key[0], "answered", early - asked)], True
        elif asked is None:  # an answer ahead of its request, or after all is over: forgotten when the watermark has passed it
            self.handle.registerTimer(early // 1000 + 1)
        self.request.update((asked, until, early, closed))
        yield pd.DataFrame(out, columns=["request_id", "outcome", "took_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.request.exists():
            return
        asked, until, early, closed = self.request.get()
        if until is not None and expiredTimerInfo.getExpiryTimeInMs() * 1000 < until:
            return
        self.request.clear()
        if asked is not None and not closed:
            yield pd.DataFrame([(key[0], "timeout", until - asked)], columns=["request_id", "outcome", "took_us"])

    def close(self) -> None:
        pass


DEADLINE_EVENT = "request_id bigint, ts_us bigint, kind string, limit_us bigint"
ENDED = "request_id bigint, outcome string, took_us bigint"


def deadline_stream(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """ENDED of a stream of DEADLINE_EVENT (kind request, with its limit, or answer): a request is answered by its first answer
    before the limit, or has a row of its own when event time has passed it; later answers say nothing. State goes with that."""
    timed = events.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", late)
    return timed.groupBy("request_id").transformWithStateInPandas(DeadlineProcessor(), ENDED, "Append", "EventTime")


def deadlines(events: DataFrame) -> DataFrame:
    """`deadline_stream` of a table, where all of time has passed: one aggregate by request. Requests that repeat an id count once,
    at their first; answers without a request say nothing."""
    when = lambda kind, c: F.when(F.col("kind") == kind, c)
    asked = F.min(when("request", F.struct("ts_us", "limit_us")))
    answers = events.groupBy("request_id").agg(asked.alias("asked"), F.min(when("answer", F.col("ts_us"))).alias("early")).where("asked is not null")
    good = F.col("early") < F.col("asked.ts_us") + F.col("asked.limit_us")
    return answers.select("request_id", F.when(good, "answered").otherwise("timeout").alias("outcome"), F.when(good, F.col("early") - F.col("asked.ts_us")).otherwise(F.col("asked.limit_us")).alias("took_us"))


def not_cancelled(requests: DataFrame, cancels: DataFrame, within: str, late: str = "1 minute") -> DataFrame:
    """The requests (request_id, at, ...) that no cancel (request_id, at) follows within the given time: what was cancelled has no
    result and no error. Of tables and of streams; a stream gives a request when event time has passed the time in which it may be
    cancelled, and its state keeps no longer than that. A request with a null id or time can't be cancelled in a table."""
    r = requests.withWatermark("at", late) if requests.isStreaming else requests
    c = cancels.select(F.col("request_id").alias("__id"), F.col("at").alias("__at"))
    c = c.withWatermark("__at", late) if cancels.isStreaming else c
    on = (F.col("request_id") == F.col("__id")) & (F.col("__at") >= F.col("at")) & (F.col("__at") < F.col("at") + F.expr(f"interval {within}"))
    if not requests.isStreaming:
        return r.join(c, on, "left_anti")
    return r.join(c, on, "leftOuter").where("__id is null").drop("__id", "__at")
