"""Substring deduplication with fixed-block anchors.

A word goes if a window of 13 words that covers it also starts in a document with a smaller doc_id.

Method. Each document's non-overlapping blocks of 7 words are the index; its rolling 7-word windows are
the probes. Any 13 words hold one aligned block, so a repeat must show as a probe of one document that
hits a block of another (first round). Around the hits, and only there, the 13-word windows are compared
(second round): the least document of each is found, and hits extend to maximal exact repeats as the
union of the windows that an earlier document has.

Blocks and probes are 31-bit hashes within a bucket, which only rule out; windows are compared by 64-bit
hashes. Both rounds go through the chunk exchange, so a passage in a third of all documents costs one
entry for each chunk.

Defined results: null texts have no words; texts with fewer than 13 words keep all; rows that repeat a
doc_id are not earlier than each other; rows with a null doc_id neither remove nor lose anything. An empty table gives no
rows; very long texts are read whole; extra columns are not read; of equal windows the document with the least doc_id keeps its own.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U, byte_table, doc_words, utf8, windows_hash
from .exchange import BLOBS, REPLY, Short, blob_rows, bodies, replies_of, reply_rows, shared_bits, sized_chunks

SPAN, BLOCK_WORDS = 13, 7
_TABLE = byte_table(seed=5)


class Chunk:
    """One chunk's documents with what both rounds need of them, always in the same order."""

    def __init__(self, table: pa.Table, buckets: int, unknown: bool = False):
        table = table if unknown else table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.table, self.buckets = table, buckets
        self.ids = np.zeros(table.num_rows, np.int64) if unknown else table.column("doc_id").to_numpy()
        raw, off = utf8(table.column("text"))
        _, _, self.h, self.first, self.count = doc_words(raw, off, _TABLE)
        n = len(self.h)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.place = np.arange(n) - self.first[self.doc]
        self.left = self.count[self.doc] - self.place  # words from here on
        # A document too short for a window neither asks nor answers.
        able = self.count[self.doc] >= SPAN
        self.probe = np.flatnonzero(able & (self.left >= BLOCK_WORDS))
        self.short = Short(windows_hash(self.h, BLOCK_WORDS)[self.probe] if len(self.probe) else np.zeros(0, U), buckets)

    def first_round(self, chunk: int) -> pa.RecordBatch:
        aligned = np.zeros(len(self.short.keys), bool)
        aligned[self.short.at()[self.place[self.probe] % BLOCK_WORDS == 0]] = True
        return self.short.blobs(1, chunk, aligned)

    def windows(self, replies: dict[int, bytes]) -> None:
        """The 13-word windows around hits: hash and document; distinct hashes with their least document."""
        at = self.short.at()
        often = np.bincount(at, minlength=len(self.short.keys)) > 1  # within the chunk
        hit = np.zeros(len(self.h) + SPAN, bool)
        hit[self.probe] = (self.short.answers(replies)[:, 0] | often)[at]
        near = np.zeros(len(self.h), bool)
        for o in range(SPAN - BLOCK_WORDS + 1):
            near |= hit[o : o + len(self.h)]
        self.start = np.flatnonzero(near & (self.left >= SPAN))
        h = windows_hash(self.h, SPAN)[self.start] if len(self.start) else np.zeros(0, U)
        order = np.argsort(h, kind="stable")  # documents ascend within equal hashes
        h = h[order]
        head = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        run = np.cumsum(head) - 1
        self.keys, self.least = h[head], self.ids[self.doc[self.start[order[head]]]]
        self.key_of = np.empty(len(h), np.int64)
        self.key_of[order] = run
        bucket = (self.keys % U(self.buckets)).astype(np.int64)
        self.sent = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[self.sent], np.arange(self.buckets + 1))

    def second_round(self, chunk: int) -> pa.RecordBatch:
        parts = []
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            k = self.sent[a:b]
            parts.append(self.keys[k].tobytes() + self.least[k].tobytes())
        return blob_rows(2, chunk, parts)

    def removed(self, replies: dict[int, bytes]) -> np.ndarray:
        """A flag for each word."""
        earlier = np.zeros(len(self.keys), bool)
        for bucket, bits in replies.items():
            a, b = self.cuts[bucket], self.cuts[bucket + 1]
            earlier[self.sent[a:b]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        gone = earlier[self.key_of] | (self.ids[self.doc[self.start]] > self.least[self.key_of])
        step = np.zeros(len(self.h) + SPAN + 1, np.int32)
        np.add.at(step, self.start[gone], 1)
        np.add.at(step, self.start[gone] + SPAN, -1)
        return np.cumsum(step)[: len(self.h)] > 0


def least_bits(parts: list[bytes]) -> list[bytes]:
    """For (hash, least document) entries of one bucket: whether another chunk has a smaller one."""
    sizes = [len(x) // 16 for x in parts]
    h = np.concatenate([np.frombuffer(x, U, n) for x, n in zip(parts, sizes, strict=True)])
    doc = np.concatenate([np.frombuffer(x, np.int64, n, 8 * n) for x, n in zip(parts, sizes, strict=True)])
    order = np.argsort(h)
    s = h[order]
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    low = np.minimum.reduceat(doc[order], head)
    bits = np.empty(len(h), bool)
    bits[order] = np.repeat(low, np.diff(np.append(head, len(h)))) < doc[order]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return [np.packbits(bits[a:b]).tobytes() for a, b in zip(ends, ends[1:], strict=False)]


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:bigint,length:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
    return edge[0::2], edge[1::2]


def dedup_substrings(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (word ranges that go), and the kept text if asked."""
    d, buckets = sized_chunks(docs)

    def ask(key, table):
        return pa.Table.from_batches([Chunk(table, buckets).first_round(key[0].as_py())])

    def answer(key, table):
        chunks, parts = bodies(table)
        which = table.column("round")[0].as_py()
        return reply_rows(which, key[0].as_py(), chunks, shared_bits(chunks, parts, True) if which == 1 else least_bits(parts))

    def ask_again(key, table, replies):
        if not table.num_rows:
            return pa.Table.from_batches([blob_rows(2, 0, [])])
        c = Chunk(table, buckets)
        c.windows(replies_of(replies, 1))
        return pa.Table.from_batches([c.second_round(key[0].as_py())])

    def finish(key, table, replies):
        c = Chunk(table, buckets)
        c.windows(replies_of(replies, 1))
        return report(c, c.removed(replies_of(replies, 2)))

    def alone(batches):
        for b in batches:
            c = Chunk(pa.Table.from_batches([b]), 1, unknown=True)
            yield from report(c, np.zeros(len(c.h), bool)).to_batches()

    def report(c, gone):
        out = ([], [], [], [], [], [])
        for k, text in enumerate(c.table.column("text").to_pylist()):
            f, n = int(c.first[k]), int(c.count[k])
            own = gone[f : f + n]
            words = text.encode().split()
            kept = b" ".join(compress(words, (~own).tolist()) if own.any() else words)
            a, b = runs(own)
            values = (c.table.column("doc_id")[k].as_py(), n, int(own.sum()), hashlib.sha256(kept).hexdigest(), [{"start": int(x), "length": int(y - x)} for x, y in zip(a, b, strict=True)], kept.decode() if with_text else None)
            for column, x in zip(out, values, strict=True):
                column.append(x)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS, pa.string()]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"]
        keep = 6 if with_text else 5
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)][:keep], names[:keep])

    schema = RESULT + (", kept string" if with_text else "")
    by_chunk = d.where("doc_id is not null").groupBy("chunk")
    one = by_chunk.applyInArrow(ask, BLOBS).groupBy("bucket").applyInArrow(answer, REPLY)
    two = by_chunk.cogroup(one.groupBy("chunk")).applyInArrow(ask_again, BLOBS).groupBy("bucket").applyInArrow(answer, REPLY)
    known = by_chunk.cogroup(one.unionByName(two).groupBy("chunk")).applyInArrow(finish, schema)
    return known.unionAll(d.where("doc_id is null").mapInArrow(alone, schema))
