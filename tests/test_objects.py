"""Objects of PDFs: traversal, forbidden entries, strings, embedded files, against plain versions."""

import random

from pyspark.sql import functions as F

from docloom.operators import objects as op

OBJECT = "doc_id bigint, object_id int, indirect boolean, kind string, type string, text string, size bigint"
ENTRY = "doc_id bigint, parent_id int, key string, child_id int"
KEY = "AKIA" + "Z" * 16


def test_reach(spark):
    r = random.Random(1)
    edges, roots = [], []
    for doc in range(12):
        n = r.randint(3, 40)
        edges += [(doc, r.randrange(n), "k", r.randrange(n)) for _ in range(n + doc)]
        roots += [(doc, r.randrange(n)) for _ in range(2)]
    edges += [(50, k, "k", k + 1) for k in range(9)] + [(51, 0, "k", k) for k in range(1, 30)] + [(52, 1, "k", 2), (52, 2, "k", 1)]
    roots += [(50, 0), (51, 0), (52, 1), (53, 7)]
    e, s = spark.createDataFrame(edges + edges[:5], ENTRY), spark.createDataFrame(roots, "doc_id bigint, object_id int")
    want = {}
    for doc, root in roots:
        front = {root}
        for depth in range(6):
            for x in front:
                want.setdefault((doc, x), depth)
                want[doc, x] = min(want[doc, x], depth)
            front = {c for d, p, _, c in edges if d == doc and p in front}
    got = op.reach(s, e, max_depth=4, max_objects=25)
    rows = {(r["doc_id"], r["object_id"]): r["depth"] for r in got.collect()}
    assert rows == want
    code = {r["doc_id"] for r in op.limits(got, 4, 25).collect()}
    deep = {d for (d, _), k in want.items() if k > 4}
    many = {d for d, _ in want if sum(x == d for x, _ in want) > 25}
    assert code == deep | many and 50 in deep and 51 in many and 52 not in code


def test_scan(spark):
    objects = [
        (1, 1, True, "dict", None, None, None), (1, 2, False, "string", None, f"a {KEY}", None), (1, 3, False, "name", None, "Title", None), (1, 4, True, "stream", None, f"BT (one {KEY}) Tj <414b> (b\\051) ET", 60),
        (1, 5, False, "string", None, "not held by anything", None), (1, 2, False, "string", None, "repeated", None),
        (2, 1, True, "dict", None, None, None), (2, 2, False, "dict", None, None, None), (3, 1, True, "array", None, None, None), (3, 2, False, "invalid", None, None, None),
        (4, 1, True, "stream", None, "x", 1000), (5, 1, True, "other", None, None, None), (6, 1, True, "dict", None, None, None), (6, 2, False, "array", None, None, None),
    ]
    entries = [(1, 1, "A", 2), (1, 1, "B", 3), (1, 1, "C", 99), (2, 1, "A", 2), (2, 2, "JavaScript", 99), (3, 1, None, 2), (6, 1, "K", 2), (6, 2, None, 1), (5, 1, "JS", 1)]
    o, e = spark.createDataFrame(objects, OBJECT).withColumn("n", F.lit("x")), spark.createDataFrame(entries, ENTRY)
    got = {r["doc_id"]: r for r in op.scan(o, e, max_decoded=500).collect()}
    assert {k: r["code"] for k, r in got.items()} == {1: None, 2: "ATTACHMENT_UNSUPPORTED", 3: "INSPECTION_FAILED", 4: "INSPECTION_LIMIT", 5: None, 6: None}
    # two strings, a name, the stream and three strings within it
    assert (got[1]["objects"], got[1]["strings"]) == (4, 6) and [tuple(x) for x in got[1]["redactions"]] == [("aws-access-key-id", 3)]
    assert (got[5]["strings"], got[6]["objects"], got[2]["objects"]) == (0, 2, None)
    chain = spark.createDataFrame([(9, k, k == 0, "array", None, None, None) for k in range(60)], OBJECT)
    links = spark.createDataFrame([(9, k, None, k + 1) for k in range(59)], ENTRY)
    assert op.scan(chain, links, max_depth=3).first()["code"] == "INSPECTION_LIMIT"
    assert op.scan(o.limit(0), e.limit(0)).collect() == []


def test_embedded_files(spark):
    spec = lambda doc, k, ef, name=None, kind="dict": [(doc, k, True, "dict", "Filespec", None, None)] + ([(doc, k + 1, False, kind, None, None, None)] if ef else []) + ([(doc, k + 2, False, "string", None, name, None)] if name is not None else [])
    stream = lambda doc, k, size=10, type_="EmbeddedFile": (doc, k, True, "stream", type_, "", size)
    objects = spec(1, 10, True, "first.pdf") + spec(1, 20, True, "last.pdf") + [stream(1, 90), stream(1, 91, 5), stream(1, 92, 5, None)]
    entries = [(1, 10, "EF", 11), (1, 11, "F", 90), (1, 10, "UF", 12), (1, 20, "EF", 21), (1, 21, "F", 90), (1, 21, "UF", 92), (1, 20, "UF", 999), (1, 20, "F", 22)]
    objects += spec(2, 10, False)  # no EF
    objects += spec(3, 10, True, None, "array") + [stream(3, 90)]
    entries += [(3, 10, "EF", 11)]
    objects += spec(4, 10, True, "x")  # EF holds no stream
    entries += [(4, 10, "EF", 11), (4, 11, "F", 12)]
    objects += spec(5, 10, True, "y") + [stream(5, 90)]  # the name is no string
    entries += [(5, 10, "EF", 11), (5, 11, "F", 90), (5, 10, "UF", 11)]
    objects += [stream(6, k) for k in range(11)]
    objects += [stream(7, 1, 11 * 1024 * 1024)]
    objects += [(8, 1, True, "dict", None, None, None), (8, 1, True, "dict", None, None, None)]
    objects += spec(9, 10, True, "")  # an empty name, and an empty EF
    entries += [(9, 10, "EF", 11), (9, 10, "F", 12)]
    o, e = spark.createDataFrame(objects, OBJECT), spark.createDataFrame(entries + entries[:3], ENTRY)
    found, documents = op.embedded_files(o, e)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 90, "last.pdf", 10), (1, 91, "embedded.bin", 5), (1, 92, "last.pdf", 5)]
    got = {r["doc_id"]: (r["code"], r["files"], r["dangling"]) for r in documents.collect()}
    failed, unsupported, limit = "INSPECTION_FAILED", "ATTACHMENT_UNSUPPORTED", "INSPECTION_LIMIT"
    assert got == {1: (None, 3, 1), 2: (unsupported, None, 0), 3: (failed, None, 0), 4: (unsupported, None, 0), 5: (failed, None, 0), 6: (limit, None, 0), 7: (limit, None, 0), 8: (None, 0, 0), 9: (failed, None, 0)}
    none, docs = op.embedded_files(o.limit(0), e.limit(0))
    assert none.collect() == docs.collect() == []
