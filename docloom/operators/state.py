"""State machines over ordered rows of one key, as folds: limits, caches, retries, budgets, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators.ordered import Cache, FixedWindow, in_order


def rate_limit(events: DataFrame, key: str, ts: str, limit: int, window_us: int) -> DataFrame:
    """key, ts (microseconds), allowed for each request. A window starts with the key's first request, and again with the
    first one that is window_us or more after the start; refused requests count. Requests without a time are left out."""
    schema = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in (key, ts)) + ", allowed boolean"
    return in_order(events.select(key, ts).where(F.col(ts).isNotNull()), [key], [ts], lambda: FixedWindow(key, ts, limit, window_us), schema)


def denied_counts(events: DataFrame, key: str, ts: str, limit: int, window_us: int) -> DataFrame:
    """key, requests, denied: the same by key. A key's rows are one partition's already, so they are counted where they are."""
    return rate_limit(events, key, ts, limit, window_us).groupBy(key).agg(F.count("*").alias("requests"), F.count_if(~F.col("allowed")).alias("denied"))


CACHE_OUT = "scope string, pos bigint, key string, cache_hit boolean"


def cache_replay(gets: DataFrame, max_entries: int = 8, max_weight: int = 1_000_000, ttl_us: int = 600_000_000) -> DataFrame:
    """gets (scope, pos, ts, key, weight, purge) to hits, one LRU cache with expiry for each scope.

    The least recently used entries go while there are too many or they weigh too much; what weighs more
    than the whole cache is never kept; a purge empties it before the row is asked. What is asked is there at once: `ordered.cache_trace` has the form with jobs
    that take time.
    """
    import pandas as pd

    class Machine:
        def __init__(self):
            self.cache = Cache(max_entries, max_weight, ttl_us, 1)

        def rows(self, pdf: pd.DataFrame) -> pd.DataFrame:
            hits = []
            for n, (ts, key, weight, purge) in enumerate(zip(pdf.ts, pdf.key, pdf.weight, pdf.purge, strict=True)):
                if purge:
                    self.cache.step("purge", ts, None, None, "", None, None)
                hits.append(bool(self.cache.step("get", ts, n, key, "", None, None)))
                if not hits[-1]:
                    self.cache.step("done", ts, n, None, "", None, int(weight))
            return pd.DataFrame({"scope": pdf.scope, "pos": pdf.pos, "key": pdf.key, "cache_hit": hits})

    return in_order(gets, ["scope"], ["ts", "pos"], Machine, CACHE_OUT)


def latest_per_scope(entries: DataFrame, scope: str, key: str, saved: str, keep: int = 10) -> DataFrame:
    """History: the newest entry of each key, then the newest keep of each scope, with rank."""
    rest = [c for c in entries.columns if c not in (scope, key)]
    newest = entries.groupBy(scope, key).agg(F.max_by(F.struct(*rest), F.col(saved)).alias("r")).select(scope, key, "r.*")
    rank = F.row_number().over(W.partitionBy(scope).orderBy(F.desc(saved), key))
    return newest.withColumn("rank", rank).where(F.col("rank") <= keep)


RETRYABLE_STATUS = [429, 500, 502, 503, 504]


def retry_outcome(attempts: Column, has_fallback: Column | bool = True) -> Column:
    """struct<outcome, used_fallback, attempts> of one call's ordered attempt kinds (ok, invalid,
    retryable, fatal, timeout): one retry after an invalid answer, one change of model."""
    fallback = has_fallback if isinstance(has_fallback, Column) else F.lit(has_fallback)
    start = F.struct(F.lit(None).cast("string").alias("outcome"), F.lit(0).alias("invalid"), F.lit(False).alias("used"), F.lit(0).alias("n"))

    def step(s, kind):
        out = (
            F.when(kind == "ok", "OK")
            .when(kind == "timeout", "AI_TIMEOUT")
            .when(kind == "fatal", "AI_UNAVAILABLE")
            .when((kind == "invalid") & (s["invalid"] >= 1), "AI_INVALID_RESPONSE")
            .when((kind == "retryable") & (s["used"] | ~fallback), "AI_UNAVAILABLE")
        )
        after = F.struct(out.alias("outcome"), (s["invalid"] + F.when(kind == "invalid", 1).otherwise(0)).alias("invalid"), (s["used"] | ((kind == "retryable") & fallback)).alias("used"), (s["n"] + 1).alias("n"))
        return F.when(s["outcome"].isNotNull(), s).otherwise(after)

    return F.aggregate(attempts, start, step, lambda s: F.struct(s["outcome"].alias("outcome"), s["used"].alias("used_fallback"), s["n"].alias("attempts")))


def attempt_kind(status: Column, parsed: Column) -> Column:
    """Kind of an attempt from its HTTP status (0: network) and whether its body was valid."""
    return F.when(status == 0, "retryable").when(status == 200, F.when(parsed, "ok").otherwise("invalid")).when(status.isin(RETRYABLE_STATUS), "retryable").otherwise("fatal")


#: Budget of one inspection.
LIMITS = {"pages": 100, "images": 30, "attachments": 10, "attachment_bytes": 20 * 1024 * 1024, "decoded": 32 * 1024 * 1024}
MAX_FILE, MAX_DEPTH = 10 * 1024 * 1024, 2


def budget_admission(nodes: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """nodes (root_id, visit, depth, pages, images, attachments, attachment_bytes, decoded, size) to root_id, code,
    failed_at: the first visit that would exceed any running total or a bound of its own. All or nothing."""
    w = W.partitionBy("root_id").orderBy("visit").rowsBetween(W.unboundedPreceding, W.currentRow)
    over = F.lit(False)
    for c, most in limits.items():
        over = over | (F.sum(c).over(w) > most) | (F.col(c) < 0)
    over = over | (F.col("size") < 1) | (F.col("size") > MAX_FILE) | (F.col("depth") > MAX_DEPTH)
    first = nodes.withColumn("bad", F.when(over, F.col("visit"))).groupBy("root_id").agg(F.min("bad").alias("failed_at"))
    return first.select("root_id", F.when(F.col("failed_at").isNotNull(), "INSPECTION_LIMIT").alias("code"), "failed_at")


def workflow_phase(actions: Column) -> Column:
    """The phase after an ordered array of actions; progress counts only while extracting."""
    start = F.struct(F.lit("idle").alias("phase"), F.lit(None).cast("int").alias("percent"))

    def step(s, a):
        kind = F.when(a["type"] == "reset", "idle").when(a["type"] == "extract", "extracting").when(a["type"] == "analyze", "analyzing").when(a["type"] == "result", "result").when(a["type"] == "fail", "error").otherwise(s["phase"])
        percent = F.when(a["type"] == "progress", F.when(s["phase"] == "extracting", a["percent"]).otherwise(s["percent"]))
        return F.struct(kind.alias("phase"), percent.alias("percent"))

    return F.aggregate(actions, start, step)


#: Codes that no retry can mend.
NOT_RETRYABLE = "NOT_PDF FILE_TOO_LARGE FILE_EMPTY MULTIPLE_FILES PDF_ENCRYPTED PDF_CORRUPT TOO_MANY_PAGES INSPECTION_FAILED INSPECTION_LIMIT ATTACHMENT_UNSUPPORTED NO_TEXT_LAYER DOCUMENT_TOO_LONG PAYLOAD_TOO_LARGE ORIGIN_NOT_ALLOWED".split()


def is_retryable(code: Column) -> Column:
    return ~code.isin(NOT_RETRYABLE)


def progress(events: DataFrame, total: Column) -> DataFrame:
    """events (job, pos, done) with completed and percent, as running counts that never pass the total."""
    w = W.partitionBy("job").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    completed = F.least(F.sum("done").over(w), total)
    return events.withColumn("completed", completed).withColumn("percent", F.floor(F.col("completed") * 100 / total))


def latency_summary(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """Nearest-rank percentiles and the population coefficient of variation. Equal values are counted before the shuffle, so that a
    group is as large as its distinct values are many; a window over those ranks them, and spills where they are too many. Samples
    without a value count in n alone."""
    rows = samples.groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    known = F.when(F.col("__v").isNotNull(), F.col("__n"))
    w = W.partitionBy(*by)
    ranked = rows.withColumns({
        "__upto": F.sum(known).over(w.orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)),
        "__values": F.sum(known).over(w), "__mean": F.sum(F.col("__v") * F.col("__n")).over(w) / F.sum(known).over(w),
    })
    at = lambda q: F.min(F.when(F.col("__upto") >= F.ceil(F.col("__values") * F.lit(q)), F.col("__v")))
    spread = F.sqrt(F.sum((F.col("__v") - F.col("__mean")) * (F.col("__v") - F.col("__mean")) * F.col("__n")) / F.first("__values"))
    return ranked.groupBy(*by).agg(
        F.sum("__n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("__v").alias("max"), F.first("__mean").alias("mean"), (spread / F.first("__mean")).alias("cv"),
    )
