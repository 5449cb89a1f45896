"""The cache with jobs in flight, deadlines and cancellation: tables against plain versions, streams against tables."""

import random

import pandas as pd
import pytest

from docloom.operators import ordered, state
from docloom.streaming import timed

SECOND = 1_000_000


def cache_events(seed=1, n=400):
    """Gets, ends, cancels and purges of three scopes; times grow, so that a stream may take them in order."""
    r = random.Random(seed)
    rows, running = [], {}
    for k in range(n):
        scope, now = f"s{r.randrange(3)}", (k + 1) * 3 * SECOND
        mine = running.setdefault(scope, [])
        kind = r.choices(["get", "done", "failed", "cancel", "purge"], [8, 5, 1, 1, 0.4])[0]
        if kind in ("done", "failed", "cancel"):
            if not mine:
                continue
            request = mine.pop(r.randrange(len(mine)))
            rows.append((scope, k, now, kind, request, None, None, None, r.choice([1, 5, 90, 200]) if kind == "done" else None))
        elif kind == "get":
            mine.append(k)
            rows.append((scope, k, now, "get", k, f"k{r.randrange(5)}", r.choice(["", "job"]), r.choice([None] * 9 + [0, 1]), None))
        else:
            rows.append((scope, k, now, "purge", None, None, None, None, None))
    return rows


def plain_cache(rows, max_entries, max_weight, ttl, job):
    """The same rules, written down again as lists that are looked through."""
    out, scopes = [], {}
    for scope, _, now, kind, request, key, name, expected, weight in rows:
        s = scopes.setdefault(scope, {"g": 0, "held": [], "jobs": []})
        s["held"] = [e for e in s["held"] if e[1] > now]
        s["jobs"] = [j for j in s["jobs"] if j["since"] + job > now]
        if kind == "purge":
            s["g"] += 1
            s["held"] = []
        elif kind == "cancel":
            for j in s["jobs"]:
                j["users"] = [u for u in j["users"] if u != request]
            s["jobs"] = [j for j in s["jobs"] if j["users"]]
        elif kind in ("done", "failed"):
            for j in [j for j in s["jobs"] if j["owner"] == request]:
                s["jobs"].remove(j)
                out += [(scope, u, "ok" if kind == "done" else "failed", kind == "done" and u != request) for u in j["users"]]
                if kind == "done" and j["g"] == s["g"] and j["keep"] and weight <= max_weight:
                    s["held"] = [e for e in s["held"] if e[0] != j["key"]] + [(j["key"], now + ttl, weight)]
                    while len(s["held"]) > max_entries or sum(e[2] for e in s["held"]) > max_weight:
                        s["held"].pop(0)
        elif expected is not None and expected != s["g"]:
            s["jobs"].append({"owner": request, "key": key, "name": "alone", "g": expected, "since": now, "users": [request], "keep": False})
        else:
            hit = [e for e in s["held"] if e[0] == key]
            same = [j for j in s["jobs"] if j["keep"] and (j["key"], j["name"], j["g"]) == (key, name, s["g"])]
            if hit:
                s["held"] = [e for e in s["held"] if e[0] != key] + hit
                out.append((scope, request, "ok", True))
            elif same:
                same[0]["users"].append(request)
            else:
                s["jobs"].append({"owner": request, "key": key, "name": name, "g": s["g"], "since": now, "users": [request], "keep": True})
    return sorted(out)


LIMITS = {"max_entries": 2, "max_weight": 100, "ttl_us": 200 * SECOND, "job_us": 150 * SECOND}


def test_cache_trace(spark):
    for seed in range(3):
        rows = cache_events(seed)
        got = ordered.cache_trace(spark.createDataFrame(rows, ordered.CACHE_EVENT).repartition(4), **LIMITS)
        want = plain_cache(rows, *LIMITS.values())
        assert sorted(tuple(r) for r in got.collect()) == want
        assert {w[2:] for w in want} == {("ok", True), ("ok", False), ("failed", False)}
    assert ordered.cache_trace(spark.createDataFrame([], ordered.CACHE_EVENT)).collect() == []


def run(spark, df, tmp_path, name):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def write(spark, rows, schema, tmp_path, part):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_cache_stream_with_restart(spark, tmp_path):
    timed.with_state_store(spark)
    rows = cache_events(7, 250)
    for part in (rows[:90], rows[90:170]):
        write(spark, part, ordered.CACHE_EVENT, tmp_path, 0)
        source = spark.readStream.schema(ordered.CACHE_EVENT).parquet(str(tmp_path / "in"))
        run(spark, timed.cache_stream(source, **LIMITS), tmp_path, "cache")  # each a query of its own, from the state of the one before
    write(spark, rows[170:], ordered.CACHE_EVENT, tmp_path, 0)
    run(spark, timed.cache_stream(spark.readStream.schema(ordered.CACHE_EVENT).parquet(str(tmp_path / "in")), **LIMITS), tmp_path, "cache")
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == plain_cache(rows, *LIMITS.values())


def test_deadlines(spark, tmp_path):
    timed.with_state_store(spark)
    r = random.Random(3)
    rows, want = [], {}
    for k in range(60):
        t, limit = (10 + k) * SECOND, r.choice([timed.AI_SECONDS, timed.CLIENT_SECONDS]) * SECOND
        rows.append((k, t, "request", limit))
        late = r.choice([None, 0, limit - 1, limit, limit + SECOND, limit // 2])
        if late is not None:
            rows.append((k, t + late, "answer", None))
            if k % 5 == 0:
                rows.append((k, t + late + 7, "answer", None))
        good = late is not None and late < limit
        want[k] = ("answered", late) if good else ("timeout", limit)
    rows.append((999, 5 * SECOND, "answer", None))
    rows.sort(key=lambda x: x[1])
    batch = timed.deadlines(spark.createDataFrame(rows, timed.DEADLINE_EVENT))
    assert {x["request_id"]: (x["outcome"], x["took_us"]) for x in batch.collect()} == want
    end = [(-1, 10_000 * SECOND, "answer", None), (-2, 20_000 * SECOND, "answer", None)]
    for part in (rows[:40], rows[40:], end[:1], end[1:]):
        write(spark, part, timed.DEADLINE_EVENT, tmp_path, 0)
        run(spark, timed.deadline_stream(spark.readStream.schema(timed.DEADLINE_EVENT).parquet(str(tmp_path / "in"))), tmp_path, "deadlines")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 60 and {x["request_id"]: (x["outcome"], x["took_us"]) for x in got} == want


def test_cancellation(spark, tmp_path):
    ask, stop = "request_id bigint, at timestamp, name string", "request_id bigint, at timestamp, why string"
    at = lambda s: pd.Timestamp(s, unit="s").to_pydatetime()
    requests = [(k, at(100 + k), f"n{k}") for k in range(40)]
    cancels = [(k, at(100 + k + d), "x") for k, d in [(3, 1), (4, 0), (5, -1), (6, 59), (7, 60), (8, 500), (99, 1), (3, 2)]]
    gone = {3, 4, 6}
    batch = timed.not_cancelled(spark.createDataFrame(requests + [(None, at(1), "none")], ask), spark.createDataFrame(cancels, stop), "60 seconds")
    assert sorted(r["name"] for r in batch.collect()) == sorted([f"n{k}" for k in range(40) if k not in gone] + ["none"])
    for k, (rows, c) in enumerate([(requests[:20], cancels[:4]), (requests[20:], cancels[4:]), ([(500, at(9000), "end")], [(501, at(9000), "")]), ([(502, at(9500), "end")], [(503, at(9500), "")])]):
        spark.createDataFrame(rows, ask).coalesce(1).write.mode("append").parquet(str(tmp_path / "ask"))
        spark.createDataFrame(c, stop).coalesce(1).write.mode("append").parquet(str(tmp_path / "stop"))
        df = timed.not_cancelled(spark.readStream.schema(ask).parquet(str(tmp_path / "ask")), spark.readStream.schema(stop).parquet(str(tmp_path / "stop")), "60 seconds")
        run(spark, df, tmp_path, f"cancel{k}")
    got = [r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["name"] != "end"]
    assert sorted(got) == sorted(f"n{k}" for k in range(40) if k not in gone)


@pytest.mark.parametrize("by", [["k"], ["k", "j"]])
def test_summaries(spark, by):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.randrange(2), k, r.choice([None, *map(float, range(30))])) for k in range(400)]
    d = spark.createDataFrame(rows, "k string, j int, pos int, v double")
    got = {tuple(x[c] for c in by): x for x in state.latency_summary(d, by, "v").collect()}
    for key in got:
        v = sorted(x[3] for x in rows if x[3] is not None and tuple(x[:2])[: len(by)] == key)
        n = sum(tuple(x[:2])[: len(by)] == key for x in rows)
        x, mean = got[key], sum(v) / len(v)
        assert (x["n"], x["max"]) == (n, v[-1]) and [x[p] for p in ("p50", "p95", "p99")] == [v[-(-len(v) * q // 100) - 1] for q in (50, 95, 99)]
        assert abs(x["mean"] - mean) < 1e-9 and abs(x["cv"] - (sum((y - mean) ** 2 for y in v) / len(v)) ** 0.5 / mean) < 1e-9


def test_windows_of_a_hot_key(spark):
    times = [(1, t) for t in range(0, 3000, 7)] + [(2, None), (2, 5)]
    got = state.rate_limit(spark.createDataFrame(times, "k bigint, t bigint"), "k", "t", 3, 100)
    start, n, want = None, 0, []
    for k, t in times[:-2]:
        start, n = (t, 1) if start is None or t - start >= 100 else (start, n + 1)
        want.append((k, t, n <= 3))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want + [(2, 5, True)])
    assert {r["k"]: (r["requests"], r["denied"]) for r in state.denied_counts(spark.createDataFrame(times, "k bigint, t bigint"), "k", "t", 3, 100).collect()}[1] == (len(want), sum(not w[2] for w in want))
