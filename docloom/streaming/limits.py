"""The same operators over streams: keyed rate limits with state, and the pipeline by micro-batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALLOWED = "user_id bigint, ts_us bigint, allowed boolean"


def rate_limit_stream(events: DataFrame, limit: int, window_us: int) -> DataFrame:
    """events (user_id, ts_us) with allowed. State is one (start, count) for each key. Within a micro-batch requests are
    taken by time; one that comes after a later micro-batch counts in the window that is open then."""

    def run(key, batches, state: GroupState):
        start, n = state.get if state.exists else (None, 0)
        ts = sorted(t for pdf in batches for t in pdf.ts_us)
        out = []
        for t in ts:
            if start is None or t - start >= window_us:
                start, n = t, 1
            else:
                n += 1
            out.append(n == 1 or n <= limit)
        state.update((start, n))
        yield pd.DataFrame({"user_id": [key[0]] * len(ts), "ts_us": ts, "allowed": out})

    return events.groupBy("user_id").applyInPandasWithState(run, ALLOWED, "start bigint, n bigint", "append", GroupStateTimeout.NoTimeout)


def analyze_stream(requests: DataFrame, extractor, sink: str, checkpoint: str):
    """A query that analyses each micro-batch of requests; results and errors are written below sink.

    extractor(prepared) gives the payloads of a micro-batch."""
    from docloom.plans.pipeline import analyze, prepare

    def each(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        good, bad = analyze(batch, extractor(prepare(batch)))
        good.write.mode("overwrite").json(f"{sink}/results/epoch={epoch}")
        bad.write.mode("overwrite").json(f"{sink}/errors/epoch={epoch}")
        batch.unpersist()

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_stream(events: DataFrame, key: str, ts: str, ttl: str) -> DataFrame:
    """First request of each key within its time to live (the cache's part that needs no order of use)."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])
