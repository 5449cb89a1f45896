"""Approximate nearest neighbours over balanced posting lists.

 1. `fit` cuts a bounded sample into lists of equal size by halving along the direction of most spread; the lists' means
    are the centroids, linked with their nearest ones (and with the next in order, so that all can be reached) in a graph
    that each task holds in memory.
 2. Equal vectors become one class with the smallest k + 1 of their ids, which is all that a result can show of them; ranks
    are cut off before the shuffle, so a vector that a third of all rows share costs a few rows for each task.
 3. A class goes to the list of its nearest centroid and, near a boundary, to further ones (`replicas`), unless one that it
    has already is nearer to them than it is (such lists are found by way of each other).
 4. A query walks the graph and asks every list whose centroid is at most `probe` times as far as the nearest one, counted
    from a floor for queries that lie on a centroid. No other limit on their number.
 5. Lists and queries meet by (list, block); vectors stream past a block's queries. Distances come from one product of
    matrices with a bound on its rounding error; what may be among the nearest is measured again exactly.
 6. A query that has found fewer than k although there are more candidates asks all lists: the exact way for the rest.

Bounds: the sample has at most `max_lists * per_sample` vectors, centroids and links of at most `max_lists` lists go to each task (22 MB at
64 dimensions). Blocks follow the lists' estimated sizes, but hold whatever comes. Above `max_lists * per_list` vectors lists grow with the
input: raise max_lists there.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or have another number of
dimensions than most (ties: the smaller number) take no part, nor do rows with a null vec_id. Rows that repeat a vec_id and its vector count
once; a vec_id with several vectors is a candidate, and a query, with each of them. Ties go to the smaller vec_id. An empty table, and
one whose only vectors are the query's own, gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U, cut, discard, mix

ROWS = "list int, block int, kind tinyint, ids array<bigint>, v "
FOUND = "query_id bigint, query_key bigint, score double, vec_id bigint"
TILE = 1 << 20


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def halves(x: np.ndarray, leaves: int) -> list[np.ndarray]:
    """Row numbers of x in `leaves` parts of equal size, one more or less; parts that lie together follow each other."""
    out, stack = [], [(np.arange(len(x)), leaves)]
    while stack:
        rows, n = stack.pop()
        if n == 1:
            out.append(rows)
            continue
        left = n // 2
        at = len(rows) * left // n
        c = x[rows] - x[rows].mean(0)
        way = c[squares(c).argmax()]
        for _ in range(6):  # power iteration
            way = c.T @ (c @ way)
            way /= max(np.sqrt(way @ way), 1e-30)
        order = np.argpartition(c @ way, at) if 0 < at < len(rows) else np.arange(len(rows))
        stack += [(rows[order[at:]], n - left), (rows[order[:at]], left)]
    return out


@dataclass
class Index:
    """Centroids (float32), their links, entries to the graph, the usual distance to a centroid, and each list's blocks."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    usual: float
    blocks: np.ndarray

    def __len__(self) -> int:
        return len(self.centroids)

    def walk(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Distances of x (float32) to the centroids that a walk over the graph comes by; infinite for the others. For those within
        `ratio` a walk goes on from every centroid that is not much farther than that from the nearest one so far."""
        wide = max(1.2, 1.5 * ratio - 0.5)
        n, k = len(x), len(self)
        seen, done = np.full((n, k), np.inf, np.float32), np.zeros((n, k), bool)
        start = self.centroids[self.entries]
        seen[:, self.entries] = np.sqrt(np.maximum(squares(x)[:, None] + squares(start)[None] - 2 * (x @ start.T), 0))
        flat = seen.reshape(-1)
        while True:
            best = seen.min(1, keepdims=True)
            rows, nodes = np.nonzero(~done & (seen <= self.reach(best, wide)))
            if not len(rows):
                return seen
            done[rows, nodes] = True
            at = (np.repeat(rows * k, self.links.shape[1]) + self.links[nodes].reshape(-1)).astype(np.int64)
            at = np.unique(at[np.isinf(flat[at])])
            for part in np.array_split(at, max(1, len(at) * x.shape[1] // TILE)):
                d = x[part // k] - self.centroids[part % k]
                flat[part] = np.sqrt(squares(d))

    def reach(self, best: np.ndarray, ratio: float) -> np.ndarray:
        return best + (ratio - 1) * np.maximum(best, np.float32(self.usual))

    def tiles(self, n: int) -> list[slice]:
        step = max(1, 4 * TILE // max(1, len(self)))
        return [slice(a, min(n, a + step)) for a in range(0, n, step)]

    def asked(self, x: np.ndarray, probe: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists that queries ask."""
        rows, lists = [], []
        for t in self.tiles(len(x)):
            seen = self.walk(x[t], probe)
            r, c = np.nonzero(seen <= self.reach(seen.min(1, keepdims=True), probe))
            rows.append(r + t.start)
            lists.append(c)
        return np.concatenate(rows), np.concatenate(lists)

    def homes(self, x: np.ndarray, near: float, replicas: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists that hold the vectors."""
        rows, lists = [], []
        for t in self.tiles(len(x)):
            seen = self.walk(x[t], near)
            best = seen.min(1, keepdims=True)
            take = min(replicas, len(self))
            order = np.argpartition(seen, take - 1, axis=1)[:, :take]
            d = np.take_along_axis(seen, order, 1)
            by = np.argsort(d, axis=1, kind="stable")
            order, d = np.take_along_axis(order, by, 1), np.take_along_axis(d, by, 1)
            kept = d <= self.reach(best, near)
            kept[:, 0] = True
            for j in range(1, take):
                for i in range(j):
                    apart = np.sqrt(squares(self.centroids[order[:, j]] - self.centroids[order[:, i]]))
                    kept[:, j] &= ~(kept[:, i] & (apart < 0.5 * d[:, j]))
            r, c = np.nonzero(kept)
            rows.append(r + t.start)
            lists.append(order[r, c])
        return np.concatenate(rows), np.concatenate(lists)


def build(sample: np.ndarray, lists: int, total: int, block_rows: int, degree: int = 16) -> Index:
    """The index over a sample (float32) of `total` vectors."""
    parts = halves(sample, lists)
    c = np.stack([sample[p].mean(0) for p in parts]).astype(np.float32)
    k, m = len(c), min(degree, len(c) - 1)
    links = np.zeros((k, m + 2), np.int32)
    for a in range(0, k, 512):
        d = squares(c)[None] - 2 * (c[a : a + 512] @ c.T)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        links[a : a + 512, :m] = np.argpartition(d, max(0, m - 1), axis=1)[:, :m]
    links[:, m], links[:, m + 1] = (np.arange(k) + 1) % k, (np.arange(k) - 1) % k
    usual = float(np.median(np.concatenate([np.sqrt(squares(sample[p] - c[j])) for j, p in enumerate(parts)])))
    entries = np.unique(np.linspace(0, k - 1, min(k, 2 * int(np.ceil(np.sqrt(k))))).astype(np.int64))
    sizes = np.array([len(p) for p in parts]) * (total / max(1, len(sample)))
    return Index(c, links, entries, usual, np.maximum(1, np.ceil(2 * sizes / block_rows)).astype(np.int32))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<float> as it was, else array<double>) of the rows that may take part, whatever their dimensions."""
    v = F.col("embedding")
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))) & F.exists(v, lambda x: x != 0)
    d = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(fine)
    return d.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(v, lambda x: x.cast(kind) + F.lit(0).cast(kind)).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])


def classes(d: DataFrame, k: int) -> DataFrame:
    """ids, v: each vector once, with its smallest k + 1 ids."""
    d = d.withColumn("h", F.xxhash64("v"))
    rank = F.dense_rank().over(W.partitionBy("h", "v").orderBy("vec_id"))
    few = d.withColumn("r", rank).where(F.col("r") <= k + 1)
    return few.groupBy("h", "v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select("ids", "v")


def placed(d: DataFrame, index: Index, kind: int, ratio: float, replicas: int | None) -> DataFrame:
    """ROWS of vectors (kind 1: each in one block of each of its lists) or of queries (kind 0: in all blocks of the lists they ask)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v")).astype(np.float32)
            if kind:
                rows, lists = index.homes(x, ratio, replicas)
                first = lists_of(b.column("ids"))
                key = mix(first[0][first[1][:-1]].astype(U))[rows] >> U(33)
                block = (key.astype(np.int64) % index.blocks[lists]).astype(np.int32)
            else:
                rows, lists = index.asked(x, ratio) if ratio else (np.repeat(np.arange(len(x)), len(index)), np.tile(np.arange(len(index)), len(x)))
                n = index.blocks[lists]
                at = np.repeat(np.cumsum(n) - n, n)
                rows, lists, block = np.repeat(rows, n), np.repeat(lists, n), (np.arange(n.sum()) - at).astype(np.int32)
            step = max(1, (8 << 20) // (8 * x.shape[1] + 64))
            for a in range(0, len(rows), step):
                r = pa.array(rows[a : a + step])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists[a : a + step].astype(np.int32)), pa.array(block[a : a + step]), pa.array(np.full(len(r), kind, np.int8)), b.column("ids").take(r), b.column("v").take(r)],
                    ["list", "block", "kind", "ids", "v"],
                )

    return d.select("ids", "v").mapInArrow(work, ROWS + d.schema["v"].dataType.simpleString())


class Asked:
    """The queries of one block and the nearest vectors that have passed them so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, keys: np.ndarray, k: int):
        self.ids, self.x, self.keys, self.k = ids, x, keys, k
        self.norm = squares(x)
        self.q, self.d, self.i = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.worst = np.full(len(ids), np.inf)

    def add(self, v: np.ndarray, ids: np.ndarray, off: np.ndarray) -> None:
        if not len(self.ids):
            return
        step = max(1, TILE // len(self.ids))
        for a in range(0, len(v), step):
            part, o = v[a : a + step], off[a : a + step + 1]
            norm = squares(part)
            d = self.norm[:, None] + norm[None] - 2 * (self.x @ part.T)
            d[(np.diff(o) == 1)[None] & (ids[o[:-1]][None] == self.ids[:, None])] = np.inf  # nothing but the query itself
            slack = 1e-12 * (self.norm + norm.max())
            bound = self.worst**2
            if len(part) >= self.k:
                bound = np.minimum(bound, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
            r, c = np.nonzero(d <= np.minimum(bound + slack, np.finfo(float).max)[:, None])
            exact = np.sqrt(squares(self.x[r] - part[c]))
            n = np.diff(o)[c]
            at = np.repeat(o[:-1][c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            q, d, i = np.repeat(r, n), np.repeat(exact, n), ids[at]
            other = i != self.ids[q]
            self.keep(np.concatenate([self.q, q[other]]), np.concatenate([self.d, d[other]]), np.concatenate([self.i, i[other]]))

    def keep(self, q: np.ndarray, d: np.ndarray, i: np.ndarray) -> None:
        """The k nearest of each query, ties to the smaller id; a candidate that comes twice counts once."""
        order = np.lexsort((i, d, q))
        q, d, i = q[order], d[order], i[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (d[1:] != d[:-1]) | (i[1:] != i[:-1])
        q, d, i = q[new], d[new], i[new]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        few = rank < self.k
        self.q, self.d, self.i = q[few], d[few], i[few]
        last = rank == self.k - 1
        self.worst[q[last]] = d[last]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.q]), pa.array(self.keys[self.q]), pa.array(self.d), pa.array(self.i)], [x.split()[0] for x in FOUND.split(", ")])


def meet(rows: DataFrame, k: int) -> DataFrame:
    """FOUND: the nearest of each block to each of its queries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, x, keys, asked = None, [], [], [], None

        def start() -> Asked:
            return Asked(np.concatenate(ids), np.concatenate(x), np.concatenate(keys), k)

        for b in batches:
            if not b.num_rows:
                continue
            lists, block, kind = (b.column(c).to_numpy() for c in ("list", "block", "kind"))
            edges = np.flatnonzero((np.diff(lists) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, e in zip([0, *edges], [*edges, b.num_rows], strict=True):
                if (lists[a], block[a]) != group:
                    if asked is not None and len(asked.q):
                        yield asked.rows()
                    group, ids, x, keys, asked = (lists[a], block[a]), [], [], [], None
                part = b.slice(a, e - a)
                if kind[a] == 0:
                    own, _ = lists_of(part.column("ids"))
                    ids.append(own[0::2])
                    keys.append(own[1::2])
                    x.append(matrix(part.column("v")))
                elif ids:
                    asked = asked or start()
                    asked.add(matrix(part.column("v")), *lists_of(part.column("ids")))
        if asked is not None and len(asked.q):
            yield asked.rows()

    together = rows.repartition("list", "block").sortWithinPartitions("list", "block", "kind")
    return together.mapInArrow(work, FOUND)


def nearest_of(found: DataFrame, k: int) -> DataFrame:
    """query_id, query_key, near: the k nearest of all blocks. Each query has k rows for each block that it asked."""
    near = F.slice(F.array_sort(F.collect_set(F.struct("score", "vec_id"))), 1, k)
    return found.groupBy("query_id", "query_key").agg(near.alias("near"))


def nearest(
    base: DataFrame, queries: DataFrame, k: int = 10, probe: float = 1.2, near: float = 1.05, replicas: int = 2, per_list: int = 1024, max_lists: int = 65536, per_sample: int = 16,
    block_rows: int = 16384, exact: bool = False,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest vectors by Euclidean distance, its own vec_id left out.

    base and queries: (vec_id, embedding). exact: all queries ask all lists, as the measure of recall."""
    d = usable(base)
    size = d.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, total = (size["dim"], size["count"]) if size else (1, 0)
    d = d.where(F.size("v") == dim)
    lists = int(min(max_lists, max(1, round(total / per_list))))
    most = lists * per_sample
    part = F.pmod(F.xxhash64("v", "vec_id", F.lit(12)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 0.95 * most / max(1, total)))
    sample = (d.where(part) if most < total else d).select("v").limit(most).toArrow()
    if not sample.num_rows:
        return base.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index = build(matrix(sample.column("v").combine_chunks()).astype(np.float32), min(lists, sample.num_rows), total, block_rows)

    q = usable(queries).where(F.size("v") == dim).dropDuplicates(["vec_id", "v"])
    q = q.select(F.array("vec_id", F.xxhash64("v")).alias("ids"), "v")
    vectors = placed(classes(d, k), index, 1, near, replicas)
    got = nearest_of(meet(vectors.unionAll(placed(q, index, 0, 0 if exact else probe, None)), k), k)
    if not exact:
        got = cut(got)
        key = [F.col("ids")[0].alias("query_id"), F.col("ids")[1].alias("query_key")]
        whole = got.where(F.size("near") == min(k, total - 1)).select("query_id", "query_key")
        short = cut(q.select(*key, "ids", "v").join(whole, ["query_id", "query_key"], "left_anti").select("ids", "v"))
        if not short.isEmpty():
            again = nearest_of(meet(vectors.unionAll(placed(short, index, 0, 0, None)), k), k)
            got = got.where(F.size("near") == min(k, total - 1)).unionByName(again)
        else:
            discard(short)
    out = got.select("query_id", F.posexplode("near").alias("at", "n"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the true neighbours that were found."""
    both = truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
