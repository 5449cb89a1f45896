"""Registered queries of state over time: shared caches, deadlines, cancellation. Part of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.catalog import micros, query
from docloom.operators import ordered
from docloom.session import table
from docloom.streaming import history, timed

SECOND = 1_000_000


@query()
def cache_answers(spark: SparkSession, d: str) -> DataFrame:
    """A cache for each user whose jobs take as many minutes as an event's value says; every tenth fails, some requests are given up, and errors
    purge the cache."""
    e = micros(spark, d)
    key = F.concat("event_type", (F.col("event_id") % 3).cast("string"))
    null = F.lit(None).cast("bigint")
    row = lambda df, pos, ts, kind, request, k, weight: df.select(
        F.col("user_id").cast("string").alias("scope"), pos.alias("pos"), ts.cast("bigint").alias("ts_us"), kind.alias("kind"), request.alias("request_id"), k.alias("key"), F.lit("").alias("name"), null.alias("expected"), weight.alias("weight"),
    )
    id_, none = F.col("event_id"), F.lit(None).cast("string")
    gets = row(e.where("event_type <> 'error'"), id_ * 4, F.col("ts_us"), F.lit("get"), id_, key, null)
    ends = row(e.where("event_type <> 'error'"), id_ * 4 + 1, F.col("ts_us") + F.col("value") * 60 * SECOND, F.when(id_ % 10 == 0, "failed").otherwise("done"), id_, none, F.col("value").cast("bigint"))
    left = row(e.where("event_id % 13 = 0"), id_ * 4 + 2, F.col("ts_us") + 600 * SECOND, F.lit("cancel"), id_, none, null)
    purges = row(e.where("event_type = 'error'"), id_ * 4 + 3, F.col("ts_us"), F.lit("purge"), null, none, null)
    return ordered.cache_trace(gets.unionAll(ends).unionAll(left).unionAll(purges), max_entries=4, max_weight=120, ttl_us=48 * 3600 * SECOND, job_us=7200 * SECOND)


@query(f"""SELECT event_id AS request_id, CASE WHEN good THEN 'answered' ELSE 'timeout' END AS outcome, CASE WHEN good THEN took ELSE s * {SECOND} END AS took_us FROM
 (SELECT *, event_id % 7 <> 0 AND took < s * {SECOND} AS good FROM (SELECT event_id, trunc(value * {SECOND})::BIGINT AS took,
  CASE event_type WHEN 'view' THEN {timed.AI_SECONDS} WHEN 'click' THEN {timed.CLIENT_SECONDS} ELSE {timed.INSPECTION_SECONDS} END AS s FROM events))""")
def answer_deadlines(spark: SparkSession, d: str) -> DataFrame:
    """Requests answered after as many seconds as an event's value says, under the deadline of their kind; every seventh has no answer."""
    e = micros(spark, d)
    seconds = F.when(F.col("event_type") == "view", timed.AI_SECONDS).when(F.col("event_type") == "click", timed.CLIENT_SECONDS).otherwise(timed.INSPECTION_SECONDS)
    asked = e.select(F.col("event_id").alias("request_id"), "ts_us", F.lit("request").alias("kind"), (seconds * SECOND).cast("bigint").alias("limit_us"))
    took = (F.col("value") * SECOND).cast("bigint")
    answers = e.where("event_id % 7 <> 0").select(F.col("event_id").alias("request_id"), F.explode(F.array(F.col("ts_us") + took, F.col("ts_us") + took + SECOND)).alias("ts_us"), F.lit("answer").alias("kind"), F.lit(None).cast("bigint").alias("limit_us"))
    return timed.deadlines(asked.unionAll(answers))


@query("""SELECT event_id, user_id FROM events r WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'error' AND c.user_id = r.user_id AND c.ts >= r.ts AND c.ts < r.ts + INTERVAL 6 HOUR)""")
def uncancelled(spark: SparkSession, d: str) -> DataFrame:
    """Events that no error of the same user follows within six hours."""
    e = table(spark, d, "events").select(F.col("user_id").alias("request_id"), F.col("ts").alias("at"), "event_id", "event_type")
    left = timed.not_cancelled(e.where("event_type <> 'error'"), e.where("event_type = 'error'"), "6 hours")
    return left.select("event_id", F.col("request_id").alias("user_id"))


SQL_ACTION = "CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'clear' WHEN event_type = 'error' THEN 'remove' ELSE 'add' END"


@query(f"""WITH k AS (SELECT user_id, list({{'id': 'k' || event_id % 23, 't': epoch_us(ts), 'a': {SQL_ACTION}}} ORDER BY ts, event_id) AS l FROM events GROUP BY user_id),
r AS (SELECT user_id, list_reduce(list_prepend({{'h': []::STRUCT(id VARCHAR, t BIGINT)[], 'id': '', 't': 0::BIGINT, 'a': ''}}, list_transform(l, lambda x: {{'h': []::STRUCT(id VARCHAR, t BIGINT)[], 'id': x.id, 't': x.t, 'a': x.a}})),
 lambda s, x: {{'h': CASE x.a WHEN 'clear' THEN []::STRUCT(id VARCHAR, t BIGINT)[] WHEN 'remove' THEN list_filter(s.h, lambda e: e.id <> x.id)
  ELSE list_slice(list_concat([{{'id': x.id, 't': x.t}}], list_filter(s.h, lambda e: e.id <> x.id)), 1, 10) END, 'id': '', 't': 0::BIGINT, 'a': ''}}) AS s FROM k)
SELECT user_id, e.id AS id, e.t AS saved_at FROM (SELECT user_id, unnest(s.h) AS e FROM r)""")
def history_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """What the history of each user holds after all of its changes, the newest ten."""
    e = micros(spark, d)
    changes = e.select(F.col("user_id").cast("string").alias("scope"), F.concat(F.lit("k"), (F.col("event_id") % 23).cast("string")).alias("id"), F.col("ts_us").alias("saved_at"), F.col("props").alias("result"), F.expr(SQL_ACTION).alias("action"), F.col("event_id").alias("pos"))
    kept = history.changed(spark.createDataFrame([], history.ENTRY), changes)
    return kept.select(F.col("scope").cast("bigint").alias("user_id"), "id", "saved_at")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"event":"request","requestId":"' || event_id || '","method":"POST","status":' || event_id % 500 || '}' WHEN 1 THEN '{"event":"ai_call","requestId":"' || event_id || '","status":' || event_id % 500 || '}'
 ELSE '{"event":"error","requestId":"' || event_id || '","code":"' || upper(event_type) || '","detail":null}' END AS line FROM events WHERE event_id % 4 < 3""")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """The log of events: what their kind may say, and nothing of their contents."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 4 == 0, "request").when(F.col("event_id") % 4 == 1, "ai_call").when(F.col("event_id") % 4 == 2, "error").otherwise("upload")
    known = e.select(kind.alias("event"), F.col("event_id").cast("string").alias("requestId"), F.lit("POST").alias("method"), (F.col("event_id") % 500).alias("status"), F.upper("event_type").alias("code"), "props")
    lines = history.log_lines(known)
    return lines.select(F.get_json_object("line", "$.requestId").cast("bigint").alias("event_id"), "line")
