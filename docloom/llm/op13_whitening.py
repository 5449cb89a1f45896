"""Whitening of embeddings by a hierarchy of merged singular value decompositions.

 1. Entries become integers, x = floor(64 c) + 1000000, and each distinct x vector counts once (combined before the shuffle).
 2. Each block of rows gives a node: its number, the exact sums, the mean, and all singular values and vectors of its
    centred rows. Nodes merge sixteen at a time, level by level: the scaled vectors of both sides and one row that
    corrects for their means, sqrt(n1 n2 / (n1 + n2)) (m1 - m2), are decomposed again. No dimension is ever dropped.
 3. The last node has the covariance's eigenvectors and eigenvalues (squares over n). Rows are whitened with them in one pass.
 4. The whitened rows of the fit list give a covariance of their own, merged in the same hierarchy; its largest
    departure from the identity is reported with each row.

Bounds: a node is d x d numbers; the driver sees the last one of either hierarchy only. Rows are taken relative to 1000000, so means and
sums are small, and centred before they are multiplied.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; so are empty vectors and vectors of another
number of dimensions than most (ties: the smaller number). Entries beyond the range of long stop at its ends. A component without
variance has null for `whitened` and is left out of `identity_error` (null if there is none left). A deviation beyond the range of long is
null; `deviation_exact` (decimal text) always holds it. Rows that repeat a vec_id, and null ids, come back each on its own; an empty
table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

SCALE, SHIFT, FAN = 64.0, 1_000_000, 16
NODE = "slot bigint, n bigint, sums array<decimal(38,0)>, mean array<double>, body array<double>"
ROWS_BLOCK = 4096


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, y: the rows that remain, as integers relative to SHIFT."""
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    limit = float(2**62)
    whole = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-limit)), F.lit(limit))).cast("bigint")
    return vectors.where(fine).select("vec_id", F.transform(v, whole).alias("y"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Node:
    """n rows: their exact sums (Python integers), mean, and either d x d scaled singular vectors or a matrix of products."""

    n: int
    sums: list[int]
    mean: np.ndarray
    body: np.ndarray

    def row(self, slot: int) -> dict:
        from decimal import Decimal

        return {"slot": slot, "n": self.n, "sums": [Decimal(s) for s in self.sums], "mean": self.mean.tolist(), "body": self.body.reshape(-1).tolist()}


def node_of(r) -> Node:
    mean = np.asarray(r["mean"], float)
    return Node(int(r["n"]), [int(s) for s in r["sums"]], mean, np.asarray(r["body"], float).reshape(-1, len(mean)))


def decomposed(rows: np.ndarray, d: int) -> np.ndarray:
    """The singular values times the vectors (as rows) of centred rows, d x d."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    out = np.zeros((d, d))
    out[: len(s)] = s[:, None] * vt
    return out


def svd_leaf(y: np.ndarray) -> Node:
    mean = y.mean(0)
    return Node(len(y), exact_sums(y), mean, decomposed(y - mean, y.shape[1]))


def merged_mean(a: Node, b: Node) -> np.ndarray:
    return a.mean + (b.mean - a.mean) * (b.n / (a.n + b.n))


def svd_merge(a: Node, b: Node) -> Node:
    gap = np.sqrt(a.n * (b.n / (a.n + b.n))) * (a.mean - b.mean)
    body = decomposed(np.vstack([a.body, b.body, gap[None]]), len(a.mean))
    return Node(a.n + b.n, [x + y for x, y in zip(a.sums, b.sums, strict=True)], merged_mean(a, b), body)


def product_leaf(w: np.ndarray) -> Node:
    mean = w.mean(0)
    c = w - mean
    return Node(len(w), [], mean, c.T @ c)


def product_merge(a: Node, b: Node) -> Node:
    gap = a.mean - b.mean
    return Node(a.n + b.n, [], merged_mean(a, b), a.body + b.body + np.outer(gap, gap) * (a.n * (b.n / (a.n + b.n))))


def exact_sums(y: np.ndarray) -> list[int]:
    """Sums of columns of integers, whatever their size."""
    if np.abs(y).max(initial=0) < (1 << 62) // max(1, len(y)):
        return [int(s) for s in y.sum(0)]
    return [sum(map(int, c)) for c in y.T]


def hierarchy(rows: DataFrame, column: str, leaf: Callable[[np.ndarray], Node], merge: Callable[[Node, Node], Node]) -> Node | None:
    """One node of all rows: leaves by blocks within a partition, then FAN nodes to one until one is left. Each level is cut."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left, n = None, [], 0
        for b in batches:
            if b.num_rows:
                left.append(matrix(b.column(column)))
                n += b.num_rows
            if n >= ROWS_BLOCK:
                own = leaf(np.concatenate(left))
                held, left, n = own if held is None else merge(held, own), [], 0
        if n:
            own = leaf(np.concatenate(left))
            held = own if held is None else merge(held, own)
        if held is not None:
            from pyspark import TaskContext

            yield pa.RecordBatch.from_pylist([held.row(TaskContext.get().partitionId())], schema=SCHEMA)

    def join(table):
        rows = table.to_pylist()
        held = node_of(rows[0])
        for r in rows[1:]:
            held = merge(held, node_of(r))
        return pa.Table.from_pylist([held.row(rows[0]["slot"])], schema=SCHEMA)

    level = cut(rows.select(column).mapInArrow(leaves, NODE))
    while (n := level.count()) > 1:
        # slots are numbers of partitions; their ranks would cost a sort, and gaps only make groups smaller
        tops = level.agg(F.max("slot")).first()[0]
        step = FAN if tops >= FAN else tops + 1
        up = cut(level.withColumn("slot", F.floor(F.col("slot") / step).cast("bigint")).groupBy("slot").applyInArrow(join, NODE))
        discard(level)
        level = up
    if not n:
        discard(level)
        return None
    out = node_of(level.first())
    discard(level)
    return out


SCHEMA = pa.schema([("slot", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())), ("body", pa.list_(pa.float64()))])


@dataclass
class Whitening:
    """n, the sums relative to SHIFT, and the leading components (rows of unit length) with their eigenvalues and shares."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    @staticmethod
    def of(node: Node, components: int) -> Whitening:
        _, s, vt = np.linalg.svd(node.body)
        values = s**2 / node.n
        k = min(components, len(s))
        # rounding leaves no singular value at zero; what is below its level has no variance
        level = (s[0] if len(s) else 0.0) * max(node.body.shape) * np.finfo(float).eps
        values = np.where(s > level, values, 0.0)
        vt = vt[:k] * np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(1)])[:, None]
        total = values.sum()
        return Whitening(node.n, node.sums, vt, values[:k], values[:k] / total if total else np.full(k, np.nan))

    def departures(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - S/n as doubles, each rounded once, and the exact sums of (n x - S)**2 (Python integers in an object array)."""
        n, s = self.n, self.sums
        most = max(int(np.abs(y).max(initial=0)) * n, max(map(abs, s), default=0))
        if most < 1 << 62:
            d = n * y - np.array(s, np.int64)
            if int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 63:
                return d / n, (d * d).sum(1).astype(object)
            parts = [(d >> 31).astype(object), (d & 0x7FFFFFFF).astype(object)]
            return d / n, (((parts[0] << 31) + parts[1]) ** 2).sum(1)
        d = n * y.astype(object) - np.array(s, object)
        return (d / n).astype(float), (d**2).sum(1)

    def whiten(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whitened rows (NaN for components without variance) and deviations."""
        c, deviation = self.departures(y)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (c @ self.vectors.T) / np.sqrt(self.values), np.nan), deviation


def fit(y: DataFrame, components: int) -> tuple[Whitening, float] | None:
    """The whitening of the distinct rows of y, and how far their whitened covariance is from the identity."""
    distinct = cut(y.select("y").distinct())
    node = hierarchy(distinct, "y", svd_leaf, svd_merge)
    if node is None:
        return None
    w = Whitening.of(node, components)
    live = w.values > 0

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = w.whiten(matrix(b.column("y")))[0][:, live]
                off = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(off), pa.array(rows.reshape(-1)))], ["w"])

    error = None
    if live.any():
        products = hierarchy(distinct.mapInArrow(whitened, "w array<double>"), "w", product_leaf, product_merge)
        error = float(np.abs(products.body / products.n - np.eye(int(live.sum()))).max())
    discard(distinct)
    return w, error


OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact string"


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """OUT: for each row of vectors (vec_id, embedding) that remains its coordinate on each leading component.

    n: rows of the fit list; deviation: the sum of (n x - S)**2 over the dimensions; explained: the component's share of the
    variance; identity_error: the largest entry of the whitened covariance less the identity."""
    y = integers(vectors)
    size = y.groupBy(F.size("y").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    y = y.where(F.size("y") == (size["dim"] if size else -1))
    fitted = fit(y, components) if size else None
    spark = vectors.sparkSession
    if fitted is None:
        return spark.createDataFrame([], OUT)
    w, error = fitted
    k = len(w.values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                rows, deviation = w.whiten(matrix(part.column("y")))
                each = np.repeat(np.arange(len(rows)), k)
                exact = [str(x) for x in deviation]
                fits = pa.array([x if x < 1 << 63 else None for x in map(int, deviation)], pa.int64())
                flat, share = rows.reshape(-1), np.tile(w.explained, len(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").cast(pa.int64()).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(each), w.n)), fits.take(pa.array(each)),
                        pa.array(flat, mask=np.isnan(flat)), pa.array(share, mask=np.isnan(share)), pa.array(np.full(len(each), error if error is not None else np.nan), mask=np.full(len(each), error is None)),
                        pa.array(exact, pa.string()).take(pa.array(each)),
                    ],
                    [c.split()[0] for c in OUT.split(", ")],
                )

    return y.mapInArrow(work, OUT)
