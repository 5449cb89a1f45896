"""Suffix-array deduplication: bytes that repeat in 50-byte strings of an earlier document go.

Method. Equal 50-byte strings must meet in one task to be sorted together. Each string is dealt by its
anchor, the 20 bytes in it with the least hash, which equal strings share; neighbouring strings mostly
share it too, so they travel as one snippet. First, anchors that no other place has are ruled out by
the chunk exchange. The snippets of the rest are then sorted in buckets by two-stage suffix sorting: only suffixes
smaller than their successors (type B) are sorted directly, the others are induced by scans over the
buckets of first bytes. Adjacent common prefixes of 50 bytes or more make the groups of equal strings;
each group's least document keeps them.

A chunk sends each distinct snippet once. Anchors that at least HOT chunks have (a boilerplate's edge
before ever new text) are dealt string by string, by the string's own hash, so that no bucket grows with
one frequent anchor.

Defined results: null texts are empty; texts under 50 bytes keep all; rows that repeat a doc_id are not
earlier than each other; rows with a null doc_id neither remove nor lose anything. Kept bytes may end
within a character, so the kept text is binary. An empty table gives no rows; very long texts are read whole, in chunks of their own; extra
columns are not read; of equal strings the document with the least doc_id keeps its own, and nothing else decides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U, byte_table, prefix_sums, spans_hash, utf8
from .exchange import BLOBS, REPLY, Short, blob_rows, bodies, replies_of, reply_rows, shared_bits, sized_chunks

SPAN, GRAM, HOT, PARTS = 50, 20, 512, 8
BLOCK = (1 << 19) - 256
_TABLE = byte_table(seed=17)
_LOW = U((1 << 21) - 1)


# ---------------------------------------------------------------- suffix sorting


def types_b(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one is not, as the empty one follows."""
    n = len(text)
    if n == 0:
        return np.zeros(0, bool)
    end = np.flatnonzero(np.append(text[:-1] != text[1:], True))  # of each run of equal bytes
    rises = np.append(text[end[:-1]] < text[end[:-1] + 1], False)
    return np.repeat(rises, np.diff(end, prepend=-1))


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """wanted suffixes (a mask) in the order of their first depth bytes, by two-stage sorting.

    A type A suffix is induced from its successor, so those from a wanted one to the next type B join.
    """
    n = len(text)
    if not wanted.any():
        return np.zeros(0, np.int64)
    b = types_b(text)
    need = wanted.copy()
    last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    for _ in range(n):  # as many rounds as the longest fall of bytes
        more = last[~b[last]] + 1
        more = more[more < n]
        last = more[~need[more]]
        if not len(last):
            break
        need[last] = True
    sort = np.flatnonzero(need & b)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[sort])
    sort = sort[np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")]
    del rows
    heads = np.searchsorted(text[sort], np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    if need[n - 1]:  # its successor is the empty suffix, the first of all
        queue[text[n - 1]].append(np.array([n - 1]))
    out = []

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        """Deals the type A predecessors to their buckets; returns those of bucket c itself."""
        p = found[found > 0] - 1
        p = p[need[p] & ~b[p]]
        first = text[p]
        own = p[first == c]
        rest, first = p[first != c], first[first != c]
        if len(rest):
            order = np.argsort(first, kind="stable")
            rest, first = rest[order], first[order]
            cuts = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(rest, cuts):
                queue[text[part[0]]].append(part)
        return own

    for c in range(256):
        wave = np.concatenate(queue[c]) if queue[c] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        direct = sort[heads[c] : heads[c + 1]]
        if len(direct):
            out.append(direct)
            induce(direct, c)
    order = np.concatenate(out)
    return order[wanted[order]]


def adjacent_prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it, at most cap (first: 0)."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    n = len(text)
    padded = np.concatenate([text, np.zeros(cap + 16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(), (len(padded) - 7, 8), (1, 1))
    live = np.arange(1, len(order))
    for o in range(0, cap, 8):
        i, j = order[live] + o, order[live - 1] + o
        x = np.ascontiguousarray(words[i]).view("<u8").ravel() ^ np.ascontiguousarray(words[j]).view("<u8").ravel()
        low = x & (~x + U(1))
        same = np.where(x == 0, 8, np.maximum(np.frexp(low.astype(np.float64))[1] - 1, 0) // 8)
        out[live] += same
        live = live[x == 0]
    return np.minimum(np.minimum(out, cap), n - np.maximum(order, np.append(0, order[:-1])))


def suffix_array(data: bytes) -> np.ndarray:
    """All suffixes of data in order."""
    text = np.frombuffer(data, np.uint8)
    return suffix_order(text, np.ones(len(text), bool), max(1, len(text)))


# ---------------------------------------------------------------- chunks


def snippets(raw: np.ndarray, off: np.ndarray):
    """(first start, last start, anchor's hash, document) of runs of 50-byte strings with one anchor."""
    doc_end = np.repeat(off[1:], np.diff(off))
    S, E, H = [], [], []
    n = len(raw)
    for a in range(0, max(0, n - SPAN + 1), BLOCK):
        b = min(n - SPAN + 1, a + BLOCK)
        part = raw[a : b + SPAN - 1]
        p = prefix_sums(_TABLE[part])
        g = len(part) - GRAM + 1
        i = np.arange(g)
        h = spans_hash(p, i, i + GRAM)
        key = (h & ~_LOW) | i.astype(U)
        span = SPAN - GRAM + 1  # grams in a string
        low, w = key, 1
        while 2 * w <= span:
            low = np.minimum(low[: len(low) - w], low[w:])
            w *= 2
        if w < span:
            low = np.minimum(low[: g - span + 1], low[span - w : span - w + g - span + 1])
        anchor = (low & _LOW).astype(np.int64)
        start = np.flatnonzero(np.arange(a, b) + SPAN <= doc_end[a:b])
        if not len(start):
            continue
        at = anchor[start]
        head = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
        k = np.flatnonzero(head)
        S.append(start[k] + a)
        E.append(start[np.append(k[1:], len(start)) - 1] + a)
        H.append(h[at[k]])
    if not S:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U), z
    s, e, h = np.concatenate(S), np.concatenate(E), np.concatenate(H)
    return s, e, h, np.searchsorted(off, s, "right") - 1


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[k], first[k]+1, ... size[k] of them, for each k."""
    off = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(first - off[:-1], size) + np.arange(off[-1])


class Chunk:
    def __init__(self, table: pa.Table, buckets: int, unknown: bool = False):
        table = table if unknown else table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.table, self.buckets = table, buckets
        self.ids = np.zeros(table.num_rows, np.int64) if unknown else table.column("doc_id").to_numpy()
        self.raw, self.off = utf8(table.column("text"))
        if not unknown:
            self.s, self.e, self.h, self.doc = snippets(self.raw, self.off)
            self.short = Short(self.h, buckets)

    def candidates(self, replies: dict[int, bytes]) -> None:
        at = self.short.at()
        often = np.bincount(at, minlength=len(self.short.keys)) > 1
        bits = self.short.answers(replies, 2)
        keep, hot = (bits[:, 0] | often)[at], bits[:, 1][at]
        s, e, h, doc = (x[keep] for x in (self.s, self.e, self.h, self.doc))
        hot = hot[keep]
        pre = self._sums()
        if hot.any():  # string by string
            one = ragged(s[hot], (e - s + 1)[hot])
            many = np.repeat(doc[hot], (e - s + 1)[hot])
            s, e, doc = np.concatenate([s[~hot], one]), np.concatenate([e[~hot], one]), np.concatenate([doc[~hot], many])
            h = np.concatenate([h[~hot], self._hash(pre, one, one + SPAN)])
            order = np.argsort(s, kind="stable")
            s, e, h, doc = s[order], e[order], h[order], doc[order]
        content = self._hash(pre, s, e + SPAN)
        order = np.argsort(content, kind="stable")  # documents ascend
        c = content[order]
        head = np.concatenate([[True], c[1:] != c[:-1]]) if len(c) else np.zeros(0, bool)
        self.key_of = np.empty(len(s), np.int64)
        self.key_of[order] = np.cumsum(head) - 1
        k = order[head]
        self.us, self.ue, self.udoc = s, e, doc
        self.ks, self.kn, self.least = s[k], (e - s + 1)[k], self.ids[doc[k]]
        # Buckets come in PARTS, which their task sorts one after the other.
        whole = U(self.buckets)
        bucket = (h[k] % whole * U(PARTS) + h[k] // whole % U(PARTS)).astype(np.int64)
        self.sent = np.argsort(bucket, kind="stable")
        self.part_cuts = np.searchsorted(bucket[self.sent], np.arange(self.buckets * PARTS + 1))
        self.cuts = self.part_cuts[::PARTS]

    def _sums(self):
        """Prefix hashes of the chunk, by blocks whose neighbours overlap by a snippet."""
        return [(a, prefix_sums(_TABLE[self.raw[a : a + BLOCK + 4 * SPAN]])) for a in range(0, max(1, len(self.raw)), BLOCK)]

    def _hash(self, pre, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        out = np.empty(len(s), U)
        block = s // BLOCK
        for k, (a, p) in enumerate(pre):
            m = block == k
            if m.any():
                out[m] = spans_hash(p, s[m] - a, e[m] - a)
        return out

    def second_round(self, chunk: int) -> pa.RecordBatch:
        parts = []
        for q, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            k = self.sent[a:b]
            if len(k) == 0:
                parts.append(b"")
                continue
            text = self.raw[ragged(self.ks[k], self.kn[k] + SPAN - 1)]
            sizes = np.diff(self.part_cuts[q * PARTS : (q + 1) * PARTS + 1]).astype(np.uint32)
            parts.append(b"".join((sizes.tobytes(), self.least[k].tobytes(), self.kn[k].astype(np.uint8).tobytes(), text.tobytes())))
        return blob_rows(2, chunk, parts)

    def removed(self, replies: dict[int, bytes]) -> np.ndarray:
        """A flag for each byte."""
        size = self.kn
        first = np.concatenate([[0], np.cumsum(size)])
        flags = np.zeros(first[-1], bool)
        for bucket, bits in replies.items():
            k = self.sent[self.cuts[bucket] : self.cuts[bucket + 1]]
            flags[ragged(first[k], size[k])] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(size[k].sum())).astype(bool)
        n = self.ue - self.us + 1
        gone = flags[ragged(first[self.key_of], n)] | np.repeat(self.ids[self.udoc] > self.least[self.key_of], n)
        start = ragged(self.us, n)[gone]
        m = len(self.raw)
        step = np.bincount(start, minlength=m + SPAN + 1) - np.bincount(start + SPAN, minlength=m + SPAN + 1)
        return np.cumsum(step)[:m] > 0


class Snippets:
    """What one chunk sent to a bucket: sizes of the PARTS, then documents, string counts, bytes."""

    def __init__(self, body: bytes):
        sizes = np.frombuffer(body, np.uint32, PARTS).astype(np.int64)
        n, at = int(sizes.sum()), 4 * PARTS
        self.cuts = np.concatenate([[0], np.cumsum(sizes)])
        self.doc = np.frombuffer(body, np.int64, n, at)
        self.count = np.frombuffer(body, np.uint8, n, at + 8 * n)
        self.text = np.frombuffer(body, np.uint8, -1, at + 9 * n)
        self.start = np.concatenate([[0], np.cumsum(self.count.astype(np.int64) + SPAN - 1)])

    def part(self, q: int):
        a, b = self.cuts[q], self.cuts[q + 1]
        return self.doc[a:b], self.count[a:b].astype(np.int64), self.text[self.start[a] : self.start[b]]


def sorted_bits(bodies_: list[bytes]) -> list[bytes]:
    """For each string that a chunk sent, in order: whether an earlier document has it."""
    sent = [Snippets(x) for x in bodies_]
    found: list[list[np.ndarray]] = [[] for _ in sent]
    for q in range(PARTS):
        parts = [x.part(q) for x in sent]
        bits = repeats(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        ends = np.cumsum([int(count.sum()) for _, count, _ in parts])
        for own, x in zip(found, np.split(bits, ends[:-1]), strict=True):
            own.append(x)
    return [np.packbits(np.concatenate(x)).tobytes() for x in found]


def repeats(doc: np.ndarray, count: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Sorts the strings of snippets (count each, in text) and flags those that a smaller doc has too."""
    if not len(doc):
        return np.zeros(0, bool)
    first = np.concatenate([[0], np.cumsum(count + SPAN - 1)])[:-1]
    start = ragged(first, count)
    wanted = np.zeros(len(text), bool)
    wanted[start] = True
    owner = np.zeros(len(text), np.int64)
    owner[start] = np.repeat(doc, count)
    order = suffix_order(text, wanted, SPAN)
    head = np.flatnonzero(adjacent_prefixes(text, order, SPAN) < SPAN)
    own = owner[order]
    low = np.repeat(np.minimum.reduceat(own, head), np.diff(np.append(head, len(order))))
    flag = np.zeros(len(text), bool)
    flag[order] = low < own
    return flag[start]


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def dedup_bytes(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked."""
    d, buckets = sized_chunks(docs)
    schema = RESULT + (", kept binary" if with_text else "")

    def ask(key, table):
        c = Chunk(table, buckets)
        return pa.Table.from_batches([c.short.blobs(1, key[0].as_py())])

    def answer(key, table):
        chunks, parts = bodies(table)
        which = table.column("round")[0].as_py()
        return reply_rows(which, key[0].as_py(), chunks, shared_bits(chunks, parts, False, HOT) if which == 1 else sorted_bits(parts))

    def ask_again(key, table, replies):
        if not table.num_rows:
            return pa.Table.from_batches([blob_rows(2, 0, [])])
        c = Chunk(table, buckets)
        c.candidates(replies_of(replies, 1))
        return pa.Table.from_batches([c.second_round(key[0].as_py())])

    def finish(key, table, replies):
        c = Chunk(table, buckets)
        c.candidates(replies_of(replies, 1))
        return report(c, c.removed(replies_of(replies, 2)))

    def alone(batches):
        for b in batches:
            c = Chunk(pa.Table.from_batches([b]), 1, unknown=True)
            yield from report(c, np.zeros(len(c.raw), bool)).to_batches()

    def report(c, gone):
        out = ([], [], [], [], [], [])
        ids = c.table.column("doc_id").to_pylist()
        for k, doc in enumerate(ids):
            a, b = int(c.off[k]), int(c.off[k + 1])
            own, text = gone[a:b], c.raw[a:b]
            n = int(own.sum())
            kept = (text[~own] if n else text).tobytes()
            spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if n else 0
            for column, x in zip(out, (doc, b - a, n, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                column.append(x)
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        keep = 6 if with_text else 5
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)][:keep], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:keep])

    by_chunk = d.where("doc_id is not null").groupBy("chunk")
    one = by_chunk.applyInArrow(ask, BLOBS).groupBy("bucket").applyInArrow(answer, REPLY)
    two = by_chunk.cogroup(one.groupBy("chunk")).applyInArrow(ask_again, BLOBS).groupBy("bucket").applyInArrow(answer, REPLY)
    known = by_chunk.cogroup(one.unionByName(two).groupBy("chunk")).applyInArrow(finish, schema)
    return known.unionAll(d.where("doc_id is null").mapInArrow(alone, schema))
