"""JSON as rows of nodes: strict reading, flattening, the keyword filter and the way back, against plain recursion."""

import json
import random

from pyspark.sql import functions as F

from docloom.sources import json_tree as op

GOOD = {"fileName": "a.pdf", "pageCount": 2, "pages": [{"number": 1, "text": "x"}, {"number": 2, "text": "y", "source": "ocr"}], "inspection": {"profile": "p", "attachments": 0, "images": 1, "barcodes": 0, "metadata": 0, "cacheHit": False, "redactions": [{"kind": "k", "count": 1}]}}


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "k bigint, t string, steps string")


def test_strict(spark):
    def edited(**change):
        return json.dumps(GOOD | change)

    texts = [
        json.dumps(GOOD), edited(extra=1), edited(pages=[{"number": "1", "text": "x", "image": {"a": [1]}}]), edited(pageCount=1.5), edited(pageCount=2.0), "{broken", None, "[1]",
        json.dumps({"fileName": None, "pages": [{}, 5]}), edited(inspection={"profile": "p"}), edited(pages={}), '{"a": 1, "a": 2}', edited(pages=[{"number": 1, "text": "x", "source": None}]),
    ]
    good, errors = op.read_strictly(frame(spark, texts), F.col("k"), F.col("t"))
    got = {r["doc_id"]: (r["code"], [tuple(i) for i in r["issues"]]) for r in errors.collect()}
    rows = {r["doc_id"]: r for r in good.collect()}
    assert set(rows) == {0, 4} and set(got) == set(range(13)) - {0, 4}
    assert rows[0]["pages"][1]["source"] == "ocr" and rows[4]["page_count"] == 2 and rows[0]["inspection"]["redactions"][0]["count"] == 1
    broken = ("BAD_REQUEST", [("(root)", "Invalid JSON.")])
    assert got[5] == got[6] == got[11] == broken
    assert got[1] == ("VALIDATION_FAILED", [("(root)", 'Unrecognized key: "extra".')])
    assert got[2][1] == [("pages.0", 'Unrecognized key: "image".'), ("pages.0.number", "Expected integer, received string.")]
    assert got[3][1] == [("pageCount", "Expected integer, received number.")]
    assert got[7][1] == [("(root)", "Expected object, received array.")]
    assert got[8][1] == [("fileName", "Expected string, received null."), ("pageCount", "Expected integer, received nothing."), ("pages.0.number", "Expected integer, received nothing."), ("pages.0.text", "Expected string, received nothing."), ("pages.1", "Expected object, received number.")]
    assert [p for p, _ in got[9][1]] == [f"inspection.{c}" for c in ("attachments", "barcodes", "cacheHit", "images", "metadata", "redactions")]
    assert got[10][1] == [("pages", "Expected array, received object.")] and got[12][1] == [("pages.0.source", "Expected string, received null.")]
    assert op.issues(frame(spark, [edited(**{f"x{k:03}": 1 for k in range(50)})]), F.col("k"), F.col("t"), op.REQUEST_JSON, 7).first()["issues"][6]["message"] == 'Unrecognized key: "x006".'


def values(x, path=""):
    if isinstance(x, dict) and x:
        return [v for k, y in x.items() for v in values(y, f"{path}.{k}")]
    if isinstance(x, list) and x:
        return [v for k, y in enumerate(x) for v in values(y, f"{path}.{k}")]
    return [path[1:] or "(root)"]


def made(r, depth=0):
    kind = r.randrange(8 if depth < 5 else 5)
    if kind >= 5:
        return [made(r, depth + 1) for _ in range(r.randint(0, 3))] if kind == 5 else {r.choice(["type", "properties", "a.b", 'q"t', "maxItems", "żó", "items", "x"]): made(r, depth + 1) for _ in range(r.randint(0, 4))}
    return [None, True, r.randint(-50, 50), 'te"x\nt ż', 0.5][kind]


def test_flattened(spark):
    r = random.Random(5)
    data = [made(r) for _ in range(60)]
    texts = [json.dumps(x) for x in data] + ["no json", '"' + "y" * 300 + '"', "[" * 12 + "]" * 12, json.dumps(list(range(200)))]
    got, reports = op.flattened(frame(spark, texts), F.col("k"), F.col("t"), max_depth=9, max_nodes=150, max_chars=290 + 800)
    code = {x["id"]: x["code"] for x in reports.collect()}
    long = {k for k, t in enumerate(texts) if len(t) > 1090}
    assert {k: c for k, c in code.items() if c} == {60: "INSPECTION_FAILED", 62: "INSPECTION_LIMIT", 63: "INSPECTION_LIMIT"} | {k: "INSPECTION_LIMIT" for k in long}
    by = {}
    for x in got.collect():
        by.setdefault(x["id"], []).append(x["path"])
    for k, x in enumerate(data):
        if code[k] is None:
            assert sorted(by[k]) == sorted(values(x))


def picked(x, parent=None):
    if isinstance(x, list):
        return [picked(y) for y in x]
    if not isinstance(x, dict):
        return x
    out = {}
    for k, y in x.items():
        field = parent == "properties"
        number = y if isinstance(y, int | float) and not isinstance(y, bool) else None
        if field or (k in op.KEYWORDS and not (k == "maxItems" and number is not None and number > 20)):
            out[k] = picked(y, k)
    return out


def test_schema_for_model(spark):
    r = random.Random(9)
    data = [{"type": "object", "$schema": "s", "properties": {"$schema": {"type": "array", "maxItems": 200, "minItems": 2, "pattern": "x"}, "maxItems": {"type": "number", "maxItems": 20, "exclusiveMinimum": 0}, "properties": {"z": {"title": 1}}}, "required": ["$schema"], "anyOf": [{"const": 1}, {"type": "null"}], "additionalProperties": False}]
    data += [x for x in (made(r) for _ in range(200)) if isinstance(x, dict)]
    texts = [json.dumps(x) for x in data] + ["[]", "nothing", None, "3"]
    schemas, errors = op.schema_for_model(frame(spark, texts), F.col("k"), F.col("t"))
    assert {x["id"] for x in errors.collect()} == set(range(len(data), len(data) + 4))
    got = {x["id"]: json.loads(x["json"]) for x in schemas.collect()}
    assert got == {k: picked(x) for k, x in enumerate(data)}
    assert op.schema_for_model(frame(spark, []), F.col("k"), F.col("t"))[0].collect() == []


def test_texts_are_counted_where_they_stand(spark):
    """Reports come from the text alone: nothing is grouped or joined, and escapes, empty containers and nulls count as nodes do."""
    r = random.Random(11)
    data = [made(r) for _ in range(60)] + ['a\\"[', {'k"[{\\': ["]", "\\", {}, [], [None]], "é\\\\": {"": "x:y"}}, [], {}, None, [[None]], "\\\\"]
    texts = [json.dumps(x, indent=r.choice([None, 2])) for x in data] + ["", "{", None, '{"a": 1, "a": 2}', '{"a":[1,{"b":[]}]}']
    values_, reports = op.flattened(frame(spark, texts), F.col("k"), F.col("t"), max_depth=9)
    plan = reports._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan

    def counted(x, depth=0):
        below = [counted(y, depth + 1) for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else [])]
        return 1 + sum(n for n, _ in below), max([depth] + [m for _, m in below])

    got = {x["id"]: (x["code"], x["nodes"], x["depth"]) for x in reports.collect()}
    assert [got[k] for k in range(len(data))] == [(None, *counted(x)) for x in data]
    n = len(data)
    assert [got[n + k] for k in range(5)] == [("INSPECTION_FAILED", 1, 0)] * 4 + [(None, 5, 3)]
    by = {}
    for x in values_.collect():
        by.setdefault(x["id"], []).append(x["path"])
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(values(x)) for k, x in [*enumerate(data), (n + 4, {"a": [1, {"b": []}]})]}
