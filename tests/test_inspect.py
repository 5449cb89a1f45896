"""Whole trees against a plain recursive version: sharing, redaction, limits, what hangs nowhere."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import inspect, tree

NODE = "root_id bigint, node_id string, parent_id string, pos int, name string, kind string, size bigint, decoded bigint, images int, barcodes int, metadata array<string>"
PAGE = "root_id bigint, node_id string, number int, text string, source string"
KEY = "AKIA" + "Z" * 16


def forest(seed=3, n=40):
    r = random.Random(seed)
    texts = ["plain", f"a {KEY} b", "  spaced  ", "", None, "other text"]
    nodes, pages = [], []

    def grow(root, name, parent, depth, pos):
        kind = r.choice(["pdf", "text", "image"])
        nodes.append((root, name, parent, pos, f"{name}.pdf" if r.random() < 0.9 else f"{KEY}.pdf", kind, 10, 10, r.randint(0, 2), r.choice([None, 0, 1]), r.choice([None, [], ["x", None, "{}"], [KEY]])))
        for k in range(r.randint(0, 2)):
            pages.append((root, name, k + 1, r.choice(texts if r.random() < 0.1 else texts[:3]), r.choice(["ocr", "attachment"])))
        if depth < 2:
            for k in range(r.randint(0, 2)):
                grow(root, f"{name}{k}", name, depth + 1, k)

    for root in range(n):
        grow(root, "r", None, 0, 0)
    copies = [(root + 100, *rest) for root, *rest in nodes if root < 5]
    pages += [(root + 100, *rest) for root, *rest in pages if root < 5]
    nodes += copies
    # equal attachments within one tree, in two places
    nodes += [(500, "r", None, 0, "r", "text", 10, 10, 0, 0, None)] + [(500, f"a{k}", "r", k, f"n{k}", "pdf", 10, 10, 1, 0, ["m"]) for k in range(3)] + [(500, "b", "a1", 0, "q", "text", 10, 10, 0, 0, None)]
    pages += [(500, f"a{k}", 1, f"same {KEY}", "ocr") for k in range(3)] + [(500, "b", 1, "under", "attachment")]
    # too many attachments; too deep; orphans and a cycle
    nodes += [(501, "r", None, 0, "r", "text", 10, 10, 0, 0, None)] + [(501, f"a{k}", "r", k, "x", "text", 10, 10, 0, 0, None) for k in range(11)]
    nodes += [(502, f"n{k}", f"n{k - 1}" if k else None, 0, "x", "text", 10, 10, 0, 0, None) for k in range(6)]
    nodes += [(503, "r", None, 0, "r", "text", 10, 10, 0, 0, None), (503, "o", "gone", 0, "x", "text", 10, 10, 0, 0, None), (503, "p", "o", 0, "x", "text", 10, 10, 0, 0, None)]
    nodes += [(504, "r", None, 0, "r", "text", 10, 10, 0, 0, None)] + [(504, f"c{k}", f"c{(k + 1) % 3}", 0, "x", "text", 10, 10, 0, 0, None) for k in range(3)]
    nodes += [(505, "r", None, 0, "r", "text", 0, 10, 0, 0, None)]
    return nodes, pages


def brute(nodes, pages):
    key = lambda t: (t or "").count(KEY)
    out = {}
    for root in {n[0] for n in nodes}:
        own = {n[1]: n for n in nodes if n[0] == root}
        kids = {name: sorted((n for n in own.values() if n[2] == name), key=lambda n: n[3]) for name in own}

        class Bad(Exception):
            pass

        used = {"pages": 0, "images": 0, "attachments": 0}

        def admit(n, depth):
            if n[6] < 1 or depth > 2:
                raise Bad("INSPECTION_LIMIT")
            used["pages"] += sum(p[:2] == n[:2] for p in pages)
            used["images"] += n[8]
            used["attachments"] += len(kids[n[1]])
            if used["pages"] > 100 or used["images"] > 30 or used["attachments"] > 10:
                raise Bad("INSPECTION_LIMIT")
            return 1 + sum(admit(c, depth + 1) for c in kids[n[1]])

        def run(n):
            got = []
            meta = [m for m in n[10] or [] if m not in (None, "", "null", "{}")]
            facts = [0, n[8], n[9] or 0, len(meta), sum(map(key, meta))]
            for p in sorted((p for p in pages if p[:2] == n[:2]), key=lambda p: p[2]):
                text = (p[3] or "").replace(KEY, "[REDACTED:aws-access-key-id]").strip()
                facts[4] += key(p[3])
                if text == "" and n[5] != "text":
                    raise Bad("INSPECTION_FAILED")
                got.append((text, p[4]))
            for c in kids[n[1]]:
                below, f = run(c)
                facts = [a + b for a, b in zip(facts, f, strict=True)]
                facts[0] += 1
                got += [(tree.ATTACHMENT + t, s) for t, s in below]
            return got, facts

        top = next(n for n in own.values() if n[2] is None)
        try:
            if admit(top, 0) < len(own):
                raise Bad("INSPECTION_FAILED")
            got, f = run(top)
            f[3] += 1
            f[4] += key(top[4])
            out[root] = (None, got, f)
        except Bad as e:
            out[root] = (str(e), None, None)
    return out


def test_execute(spark):
    nodes, pages = forest()
    n, p = spark.createDataFrame(nodes, NODE), spark.createDataFrame(pages, PAGE)
    reports, texts = inspect.execute(n.repartition(3), p.repartition(3))
    got = {r["root_id"]: r for r in reports.collect()}
    by = {}
    for r in texts.orderBy("root_id", "number").collect():
        by.setdefault(r["root_id"], []).append((r["number"], r["text"], r["source"]))
    want = brute(nodes, pages)
    assert set(got) == set(want)
    for root, (code, lines, f) in want.items():
        r = got[root]
        assert r["code"] == code, root
        if code is None:
            assert by.get(root, []) == [(k + 1, *x) for k, x in enumerate(lines)]
            assert [r["attachments"], r["images"], r["barcodes"], r["metadata"]] == f[:4]
            assert sum(x["count"] for x in r["redactions"]) == f[4]
            assert r["page_count"] == len(lines) and r["ocr_pages"] == [k + 1 for k, x in enumerate(lines) if x[1] == "ocr"]
        else:
            assert root not in by and r["page_count"] is None
    assert {c for c, *_ in want.values()} == {None, "INSPECTION_LIMIT", "INSPECTION_FAILED"}
    assert got[500]["reads"] == 4 and all(got[100 + k]["cache_hit"] for k in range(5) if want[k][0] is None)


def test_unreached(spark):
    nodes, _ = forest()
    n = spark.createDataFrame(nodes, NODE)
    chain = spark.createDataFrame([(900, f"n{k}", f"n{k - 1}" if k else None, 0) for k in range(70)] + [(901, f"n{k}", f"n{k - 1}" if k else "none", 0) for k in range(40)], "root_id bigint, node_id string, parent_id string, pos int")
    n = n.select("root_id", "node_id", "parent_id", "pos").unionAll(chain)
    got = {(r["root_id"], r["node_id"]): r["why"] for r in tree.unreached(n, tree.paths(n)).collect()}
    want = {(502, "n4"): "deep", (502, "n5"): "deep", (503, "o"): "orphan", (503, "p"): "orphan"} | {(504, f"c{k}"): "cycle" for k in range(3)}
    want |= {(900, f"n{k}"): "deep" for k in range(4, 70)} | {(901, f"n{k}"): "orphan" for k in range(40)}
    assert got == want


def test_each_content_is_read_once(spark):
    nodes, pages = forest()
    n, p = spark.createDataFrame(nodes, NODE), spark.createDataFrame(pages, PAGE)
    d = inspect.digests(tree.paths(n).where("root_id = 500"), p)
    by = {r["node_id"]: r["digest"] for r in d.collect()}
    assert by["a0"] == by["a2"] != by["a1"]
    hits = {r["node_id"]: r["cache_hit"] for r in inspect.shared(d).collect()}
    assert hits == {"r": False, "a0": False, "a1": False, "a2": True, "b": False}


@pytest.mark.parametrize("rows", [[], [(1, "r", None, 0, None, "text", 5, None, None, None, None)]])
def test_edges(spark, rows):
    reports, texts = inspect.execute(spark.createDataFrame(rows, NODE), spark.createDataFrame([], PAGE).withColumn("digest", F.lit(1)))
    assert [(r["root_id"], r["code"], r["page_count"], r["redactions"]) for r in reports.collect()] == [(1, None, 0, [])] * len(rows)
    assert texts.collect() == []


@pytest.mark.parametrize("which", [0, 1])
def test_results_are_not_broadcast(spark, which):
    """What execute returns is planned by its caller, with the caller's threshold for tables by the size of their files."""
    nodes, pages = forest()
    found = inspect.execute(spark.createDataFrame(nodes, NODE), spark.createDataFrame(pages, PAGE))[which]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
