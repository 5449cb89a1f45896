"""The history store and the log: order, limits, repeated batches, what can't be read."""

import json
import os
import random

from pyspark.sql import functions as F

from docloom.streaming import history


def made(n=300, seed=4):
    r = random.Random(seed)
    return [(f"s{r.randrange(4)}", f"i{r.randrange(25)}", (k + 1) * 10, f"r{k}", r.choices(["add", "remove", "clear"], [12, 2, 0.3])[0], k) for k in range(n)]


def plain(changes, most):
    out = {}
    for scope, id_, at, result, action, _ in changes:
        own = out.setdefault(scope, [])
        if action == "clear":
            own.clear()
        else:
            own[:] = [e for e in own if e[0] != id_]
            if action == "add":
                own.insert(0, (id_, at, result))
                del own[most:]
    return sorted((s, *e) for s, es in out.items() for e in es)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_store(spark, tmp_path):
    changes = made()
    store = history.Store(spark, str(tmp_path / "h"), 10)
    assert store.read().collect() == [] and store.version() is None
    frames = [spark.createDataFrame(changes[a : a + 100], history.CHANGE).repartition(3) for a in range(0, 300, 100)]
    for k, f in enumerate(frames):
        store.apply(f, k)
        store.apply(f, k)
    want = plain(changes, 10)
    assert rows(store.read()) == want and len(want) > 25
    store.apply(frames[0], 0)  # a batch of before, again
    assert rows(store.read()) == want and store.version() == 2
    store.apply(spark.createDataFrame([(None, "x", 1, "r", "add", 0), ("s1", None, 1, "r", "add", 0), ("s1", "x", None, "r", "add", 0), ("s1", "x", 1, "r", "other", 0)], history.CHANGE), 3)
    assert rows(store.read()) == want
    store.clean(1)
    assert rows(store.read()) == want and [n for n in os.listdir(tmp_path / "h" / "current") if n.isdigit()] == ["3"]
    # adds in any order leave the newest
    adds = [c for c in changes if c[4] == "add"]
    newest = {}
    for c in adds:
        newest[c[0], c[1]] = max(newest.get((c[0], c[1]), (0, "")), (c[2], c[3]))
    top = sorted((s, i, *v) for (s, i), v in newest.items() if sum(k[0] == s and w > v for k, w in newest.items()) < 10)
    random.Random(1).shuffle(adds)
    other = history.Store(spark, str(tmp_path / "o"), 10)
    for k in range(0, len(adds), 90):
        other.apply(spark.createDataFrame(adds[k : k + 90], history.CHANGE), k)
    assert rows(other.read()) == top
    for name in os.listdir(tmp_path / "o"):
        if name.startswith("snapshot-"):
            for f in os.listdir(tmp_path / "o" / name):
                (tmp_path / "o" / name / f).write_bytes(b"broken")
    assert other.read().collect() == []


def test_store_in_a_stream(spark, tmp_path):
    changes = made(120)
    for a in range(0, 120, 40):
        spark.createDataFrame(changes[a : a + 40], history.CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        store = history.Store(spark, str(tmp_path / "h"))
        source = spark.readStream.schema(history.CHANGE).parquet(str(tmp_path / "in"))
        q = source.writeStream.foreachBatch(store.apply).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    assert rows(store.read()) == plain(changes, 10)


def test_decoded(spark):
    result = {
        "document": {"fileName": "a.pdf", "pages": 1, "language": "pl", "type": "faktura", "title": None, "date": None}, "summary": "Jeden. Dwa. Trzy.", "keyPoints": ["a", "b", "c"],
        "entities": {"organizations": [], "people": []}, "amounts": [], "dates": [], "keywords": [],
    }
    entry = {"id": "x", "savedAt": "2026-01-02T03:04:05.000Z", "result": result}
    bad = [{**entry, "id": ""}, {**entry, "id": 5}, {**entry, "savedAt": "yesterday"}, {**entry, "result": {**result, "summary": "Jeden."}}, {**entry, "result": {}}, {"id": "y"}, 7, None]
    stored = [("a", json.dumps([entry, *bad, {**entry, "id": "z"}])), ("b", "{}"), ("c", "no json"), ("d", None), ("e", "[]")]
    got = history.decoded(spark.createDataFrame(stored, "scope string, raw string"), F.col("raw")).collect()
    assert sorted((r["scope"], r["id"], r["place"], r["saved_at"]) for r in got) == [("a", "x", 0, 1767323045000000), ("a", "z", 9, 1767323045000000)]
    assert json.loads(got[0]["result"]) == result


def test_log(spark, tmp_path):
    d = spark.createDataFrame([("request", "r1", "POST", "/v1/analyze", 200, 1.5, "secret text"), ("error", "r2", None, None, None, None, "x"), ("other", "r3", None, None, None, None, "x"), ("ai_call", "r4", None, None, 503, 2.0, "x")], "event string, requestId string, method string, route string, status int, ms double, text string")
    for _ in range(2):
        history.write_log(d, str(tmp_path / "log"), 5)
    lines = sorted((json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "log")).collect()), key=lambda x: x["requestId"])
    assert lines == [{"event": "request", "requestId": "r1", "method": "POST", "route": "/v1/analyze", "status": 200, "ms": 1.5}, {"event": "error", "requestId": "r2", "code": None, "detail": None}, {"event": "ai_call", "requestId": "r4", "status": 503, "ms": 2.0}]
