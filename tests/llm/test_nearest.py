"""Nearest neighbours: recall against brute force, ties, copies, and rows that take no part."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import op12_nearest as op

SCHEMA = "vec_id bigint, embedding array<float>, score double"


def brute(rows, k=10, dim=6):
    fine = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v and len(v) == dim and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    ids, x = np.array([i for i, _ in fine]), np.array([v for _, v in fine], np.float32).astype(float)
    out = set()
    for i, v in fine:
        if i % 100 == 0:
            d = np.sqrt(((x - np.array(v, np.float32).astype(float)) ** 2).sum(1))
            near = sorted({(round(float(a), 12), int(j)) for a, j in zip(d, ids, strict=True) if j != i})[:k]
            out |= {(i, r + 1, j, a) for r, (a, j) in enumerate(near)}
    return out


def made(n=1500, seed=2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 6)) * 4
    x = (centres[r.integers(0, 12, n)] + r.normal(size=(n, 6))).astype(np.float32)
    x[n // 3 : 2 * n // 3] = x[7]  # a vector that a third of all rows share
    rows = [(k, v.tolist(), 0.0) for k, v in enumerate(x)]
    rows += [rows[100], rows[100], (200, x[3].tolist(), 0.0)]  # repeated rows, and an id with two vectors
    rows += [(None, x[0].tolist(), 0.0), (3000, None, 0.0), (3100, [], 0.0), (3200, [0.0] * 6, 0.0), (3300, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0.0), (3400, [float("nan")] * 6, 0.0), (3500, [float("inf")] + [0.0] * 5, 0.0), (3600, [1.0, 2.0], 0.0)]
    rows += [(3700, [-0.0] + [1.0] * 5, 0.0), (3701, [0.0] + [1.0] * 5, 0.0)]
    return rows


def answers(df):
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in df.collect()}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_exact_and_recall(spark, kind):
    rows = made()
    d = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.col("embedding").cast(f"array<{kind}>")).repartition(5)
    asked = d.where("vec_id % 100 = 0")
    truth = brute(rows)
    args = {"per_list": 40, "block_rows": 32, "probe": 1.25}
    exact = op.nearest(d, asked, exact=True, **args)
    assert answers(exact) == truth
    found = op.nearest(d, asked, **args)
    assert op.recall(found, exact) >= 0.95
    got = answers(found)
    assert {(q, r) for q, r, *_ in got} == {(q, r) for q, r, *_ in truth}
    # a narrow search that finds too few in its one list asks all lists
    narrow = answers(op.nearest(d, asked, probe=1.0, near=1.0, replicas=1, per_list=4))
    assert {(q, r) for q, r, *_ in narrow} == {(q, r) for q, r, *_ in truth}


def test_walk_reaches(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 16)).astype(np.float32)
    index = op.build(x, 250, 4000, 100)
    assert len(index) == 250 and (index.blocks == 1).all()
    assert all(abs(len(p) - 16) <= 1 for p in op.halves(x, 250))
    rows, lists = index.asked(x[:300], 1.15)
    d = np.sqrt(((x[:300, None] - index.centroids[None]) ** 2).sum(2))
    near = d <= index.reach(d.min(1, keepdims=True), 1.15)
    found = np.zeros_like(near)
    found[rows, lists] = True
    assert (found & near).sum() >= 0.99 * near.sum()
    rows, lists = index.homes(x[:300], 1.05, 3)
    first = d.argmin(1)
    held = np.zeros_like(near)
    held[rows, lists] = True
    assert held[np.arange(300), first].mean() > 0.97 and held.sum(1).max() <= 3 and held.sum() > 300


def test_few(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert op.nearest(none, none).collect() == []
    one = spark.createDataFrame([(100, [1.0, 2.0], 0.0)], SCHEMA)
    assert op.nearest(one, one).collect() == []
    three = spark.createDataFrame([(100, [1.0, 2.0], 0.0), (7, [1.0, 2.0], 0.0), (5, [1.0, 2.0], 0.0), (9, [4.0, 6.0], 0.0)], SCHEMA)
    assert [(r["rank"], r["vec_id"], r["score"]) for r in op.nearest(three, three.where("vec_id = 100")).orderBy("rank").collect()] == [(1, 5, 0.0), (2, 7, 0.0), (3, 9, 5.0)]
