"""Questions between chunks of documents, answered by buckets of hashes.

Documents are dealt to chunks by a hash of doc_id. A chunk sends each bucket the distinct hashes that
fall to it, in order, as one binary row; the bucket sees all chunks' hashes and answers each chunk with
bits in the same order. So a frequent hash costs one entry for each chunk, not for each document, a
row carries thousands of hashes, and positions never travel: the chunk finds them again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, grown, small_batches

BLOBS = "round int, bucket int, chunk int, body binary"
REPLY = "chunk int, round int, bucket int, bits binary"
_BLOBS = pa.schema([("round", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int32()), ("body", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int32()), ("round", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])


#: Bytes of text in a chunk: from the first number, grown with the input from LINEAR bytes on, to the second.
CHUNK, MOST_CHUNK, LINEAR = 4 << 20, 64 << 20, 32 << 30


def sized_chunks(docs: DataFrame, least: int | None = None) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text) with about as many bytes of text in each chunk, and the number of buckets.

    Both follow the size of the input, which is one sum over the texts' lengths. Rows between chunks and
    buckets are chunks * buckets, at most one for each hash of a chunk; as chunks grow with the square root
    of the input and buckets with them, rows stay in proportion to the input up to 8 TB at the default
    sizes, and beyond that a row still carries some 25 hashes at 100 TB. Two buckets for four chunks keep
    a bucket's task at about twice a chunk, and even out what a task that has several buckets reads.
    """
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // grown(least or CHUNK, MOST_CHUNK, size, LINEAR)))
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("chunk")
    d = docs.select(chunk, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d, max(1, -(-n // 2))


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Short:
    """31-bit hashes within buckets: enough to rule out most, never all that decides."""

    def __init__(self, hashes: np.ndarray, buckets: int):
        with np.errstate(over="ignore"):
            self.all = ((hashes & U(0xFFFFFFFF)) % U(buckets)) << U(31) | hashes >> U(33)
        self.keys = sorted_distinct(self.all)
        self.starts = np.searchsorted(self.keys, np.arange(buckets + 1, dtype=U) << U(31))

    def blobs(self, which: int, chunk: int, flagged: np.ndarray | None = None) -> pa.RecordBatch:
        """flagged: a bit for each of keys, sent along as the top bit."""
        low = (self.keys & U(0x7FFFFFFF)).astype(np.uint32)
        if flagged is not None:
            low |= flagged.astype(np.uint32) << np.uint32(31)
        return blob_rows(which, chunk, [low[a:b].tobytes() for a, b in zip(self.starts, self.starts[1:], strict=False)])

    def answers(self, replies: dict[int, bytes], width: int = 1) -> np.ndarray:
        """The replies' bits, by keys; width bits each."""
        out = np.zeros((len(self.keys), width), bool)
        for bucket, bits in replies.items():
            a, b = self.starts[bucket], self.starts[bucket + 1]
            out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=(b - a) * width).reshape(-1, width)
        return out

    def at(self) -> np.ndarray:
        """Index in keys of each hash."""
        return np.searchsorted(self.keys, self.all)


def blob_rows(which: int, chunk: int, bodies: list[bytes]) -> pa.RecordBatch:
    full = [(k, x) for k, x in enumerate(bodies) if x]
    return pa.RecordBatch.from_arrays(
        [pa.array([which] * len(full), pa.int32()), pa.array([k for k, _ in full], pa.int32()), pa.array([chunk] * len(full), pa.int32()), pa.array([x for _, x in full], pa.binary())],
        schema=_BLOBS,
    )


def reply_rows(which: int, bucket: int, chunks: list[int], bits: list[bytes]) -> pa.Table:
    n = len(chunks)
    return pa.Table.from_arrays([pa.array(chunks, pa.int32()), pa.array([which] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(bits, pa.binary())], schema=_REPLY)


def bodies(table: pa.Table) -> tuple[list[int], list[bytes]]:
    """Chunks and bodies of one bucket, in the order of the chunks."""
    rows = sorted(zip(table.column("chunk").to_pylist(), table.column("body").to_pylist(), strict=True), key=lambda r: r[0])
    return [c for c, _ in rows], [x for _, x in rows]


def replies_of(table: pa.Table, which: int) -> dict[int, bytes]:
    return {b: x for r, b, x in zip(table.column("round").to_pylist(), table.column("bucket").to_pylist(), table.column("bits").to_pylist(), strict=True) if r == which}


def shared_bits(chunks: list[int], parts: list[bytes], flags: bool, hot: int = 0) -> list[bytes]:
    """For 31-bit hashes with a flag: whether another chunk has the same hash, where one of the two is
    flagged (if flags). hot: a second bit, set if at least so many chunks have the hash."""
    sizes = [len(x) // 4 for x in parts]
    raw = np.frombuffer(b"".join(parts), np.uint32)
    low, flag = raw & np.uint32(0x7FFFFFFF), raw >> np.uint32(31)
    key = np.sort(low.astype(U) << U(33) | flag.astype(U) << U(32) | np.arange(len(raw), dtype=U))
    h = key >> U(33)
    start = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    run = np.cumsum(start) - 1
    size = np.bincount(run) if len(h) else np.zeros(0, np.int64)
    marked = np.bincount(run, weights=(key >> U(32) & U(1)).astype(np.float64)) if len(h) else size
    n, m = size[run], marked[run]
    yes = n > 1
    if flags:
        yes &= m > 0
        own = (key >> U(32) & U(1)).astype(bool)
        yes &= own | (m - own > 0)
    place = (key & U(0xFFFFFFFF)).astype(np.int64)
    out = np.zeros((len(raw), 2 if hot else 1), bool)
    out[place, 0] = yes
    if hot:
        out[place, 1] = n >= hot
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return [np.packbits(out[a:b]).tobytes() for a, b in zip(ends, ends[1:], strict=False)]
