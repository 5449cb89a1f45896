"""Whitening against one decomposition of the whole matrix in numpy, and the merges on their own."""

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import op13_whitening as op

SCHEMA = "vec_id bigint, embedding array<float>, n string"


def made(n=700, d=20, seed=4):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(n, d)) @ r.normal(size=(d, d)) + r.normal(size=d) * 30).astype(np.float32)
    x[n // 3 : 2 * n // 3] = x[5]  # copies
    return x


def test_whitening(spark, monkeypatch):
    x = made()
    odd = [(None, x[3].tolist()), (9000, None), (9001, []), (9002, [float("nan")] + [0.0] * 19), (9003, [float("inf")] + [0.0] * 19), (9004, [None] + [0.0] * 19), (9005, [1.0])]
    rows = [(k, v.tolist(), "x") for k, v in enumerate(x)] + [(i, v, "x") for i, v in odd] + [(1, x[1].tolist(), "x")]
    monkeypatch.setattr(op, "ROWS_BLOCK", 16)
    monkeypatch.setattr(op, "FAN", 2)
    got = op.whiten(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    y = np.floor(64.0 * x.astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(y, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    w = ((n * y - s) / n) @ vectors[:, :16] / np.sqrt(values[:16])
    deviation = ((n * y - s).astype(object) ** 2).sum(1)
    assert len(got) == 16 * (len(x) + 2)
    by = {}
    for r in got:
        k = r["component"]
        assert r["n"] == n and abs(r["explained"] / (values[k - 1] / np.trace(v)) - 1) < 1e-9 and r["identity_error"] < 1e-9
        row = 3 if r["vec_id"] is None else r["vec_id"]
        assert r["deviation"] == deviation[row] and int(r["deviation_exact"]) == deviation[row]
        by[row, k] = r["whitened"]
    found = np.array([[by[i, k] for k in range(1, 17)] for i in range(len(x))])
    sign = np.sign((found * w).sum(0))
    assert np.abs(found * sign - w).max() < 1e-8


def test_merges_keep_everything():
    r = np.random.default_rng(1)
    y = (r.normal(size=(501, 12)) * np.logspace(0, 5, 12)).round().astype(np.int64)
    whole = op.svd_leaf(y)
    node = op.svd_leaf(y[:7])  # fewer rows than dimensions
    for a in range(7, 501, 38):
        node = op.svd_merge(node, op.svd_leaf(y[a : a + 38]))
    assert node.n == 501 and node.sums == whole.sums
    assert np.allclose(np.linalg.svd(node.body)[1], np.linalg.svd(whole.body)[1], rtol=1e-10)
    assert np.allclose(node.body.T @ node.body, whole.body.T @ whole.body, rtol=1e-9, atol=1e-3)


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert op.whiten(none).collect() == [] and op.whiten(spark.createDataFrame([(1, None, "")], SCHEMA)).collect() == []
    one = op.whiten(spark.createDataFrame([(1, [1.0, 2.0], ""), (1, [1.0, 2.0], "")], SCHEMA)).collect()
    assert [(r["component"], r["whitened"], r["deviation"], r["identity_error"]) for r in one] == [(1, None, 0, None), (2, None, 0, None)] * 2
    # one direction only: the second component has no variance
    line = op.whiten(spark.createDataFrame([(k, [float(k), float(2 * k)], "") for k in range(5)], SCHEMA)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and line[0]["identity_error"] < 1e-12
    huge = op.whiten(spark.createDataFrame([(k, [1e30 * (k - 1), float(k)], "") for k in range(3)], SCHEMA)).collect()
    assert all(r["deviation"] is None for r in huge if r["vec_id"] != 1) and all(int(r["deviation_exact"]) > 1 << 63 for r in huge if r["vec_id"] != 1)
    doubles = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.3, -0.7]), (3, [0.9, 0.1])], "vec_id bigint, embedding array<double>")
    assert op.whiten(doubles.withColumn("component", F.lit("x"))).count() == 6
