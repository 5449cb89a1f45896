"""Document fingerprints by content-defined chunking.

Method. A gear hash rolls over a text's bytes; a boundary falls where its top bits are zero, with a
stricter mask before the normal size and a looser one after it (normalised chunking), so that chunk
sizes keep close to normal and an edit moves only the boundaries near it. A fingerprint is the set of
the chunks' digests with their lengths. The likeness of one fingerprint to another is the containment:
the weight (bytes) of its chunks that the other has too, over its own weight.

Defined results: null texts are empty; an empty text has the empty fingerprint, which is like another
empty one (1.0) and unlike all else (0.0). A null doc_id
counts as the least, before every other. Ties in doc_id are ordered by a hash of the text; rows that are equal in both are
each other's next. An empty table gives no rows; very long texts are read whole. A table with one row
is its own next document. Extra columns are not read.

Neighbours are found without one task that sees all rows: texts are dealt by ranges of doc_id and sorted
within each, and only each range's last document is sent on to the next range too.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, partitions

LEAST, NORMAL, MOST = 32, 96, 384
STRICT, LOOSE = np.uint32(0xFF800000), np.uint32(0xFC000000)
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E6C63D0876A9A47)) >> np.uint64(32)).astype(np.uint32)
WHOLE_BLOCK = 1 << 22


def gear(buf: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[buf[i-j]] << j over the last 32 bytes, by doubling."""
    h = GEAR[buf]
    k = 1
    while k < 32:
        h[k:] += h[:-k] << np.uint32(k)  # the right side is a copy, made before the sum
        k *= 2
    return h


def boundaries(buf: np.ndarray) -> list[int]:
    """Ends of the chunks of one text. Long texts are hashed block by block."""
    n = len(buf)
    if n == 0:
        return []
    strict, loose = [], []
    for at in range(0, n, WHOLE_BLOCK):
        back = min(at, 31)
        h = gear(buf[at - back : at + WHOLE_BLOCK])[back:]
        loose.append(np.flatnonzero((h & LOOSE) == 0) + at + 1)
        strict.append(loose[-1][(h[loose[-1] - at - 1] & STRICT) == 0])
    return _ends(n, np.concatenate(strict).tolist(), np.concatenate(loose).tolist())


def _ends(n: int, strict: list[int], loose: list[int]) -> list[int]:
    from bisect import bisect_left

    ends, at = [], 0
    while n - at > LEAST:
        i = bisect_left(strict, at + LEAST)
        end = strict[i] if i < len(strict) and strict[i] < at + NORMAL else None
        if end is None:
            i = bisect_left(loose, at + NORMAL)
            end = loose[i] if i < len(loose) else n
        at = min(end, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> dict[int, int]:
    """Digest to length of each distinct chunk."""
    out, at = {}, 0
    for end in boundaries(np.frombuffer(data, np.uint8)):
        piece = data[at:end]
        out[xxhash.xxh3_64_intdigest(piece) & 0xFFFFFFFFFFFF] = len(piece)
        at = end
    return out


def encode(parts: dict[int, int]) -> str:
    """Sorted 6-byte digests with 2-byte lengths, in base64."""
    packed = np.array(sorted(parts), np.uint64) << np.uint64(16) | np.array([parts[k] for k in sorted(parts)], np.uint64)
    return base64.b64encode(packed.astype(">u8").tobytes()).decode()


def decode(fingerprint: str) -> dict[int, int]:
    packed = np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)
    return dict(zip((packed >> np.uint64(16)).tolist(), (packed & np.uint64(0xFFFF)).tolist(), strict=True))


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's weight that b has too."""
    whole = sum(a.values())
    return sum(w for d, w in a.items() if d in b) / whole if whole else float(not b)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each text."""

    def work(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([ids, pa.array([encode(chunks((t or "").encode())) for t in texts], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, fingerprint string")


def replace_tail(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame) -> DataFrame:
    """part, doc_id, text, ghost: sorted by doc_id within each part; a part begins with a ghost, the
    next document (in descending doc_id) of its first one."""
    d = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * partitions(docs.sparkSession)
    # Ranges of doc_id with about equal rows: n - 1 numbers on the driver.
    bounds = sorted(set(d.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n))))
    part = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b < F.col("doc_id"))) if len(bounds) < 64 else _ranged(bounds)
    d = d.withColumn("part", F.when(F.col("known"), part).otherwise(0))
    tail = F.struct("known", "doc_id", F.xxhash64("text").alias("h"))
    # One row a part, so at most n rows; also the wrap from the least document to the greatest.
    ends = {r["part"]: tuple(r["hi"]) for r in d.groupBy("part").agg(F.max(tail).alias("hi")).collect()}
    if not ends:
        return d.withColumn("ghost", F.lit(False))
    order = sorted(ends)
    to = [(k, *ends[k], order[(i + 1) % len(order)]) for i, k in enumerate(order)]
    sent = docs.sparkSession.createDataFrame(to, "part int, known boolean, doc_id bigint, h bigint, next int")
    ghosts = d.withColumn("h", F.xxhash64("text")).join(F.broadcast(sent), ["part", "known", "doc_id", "h"])
    ghosts = ghosts.select("doc_id", "known", "text", F.col("next").alias("part")).dropDuplicates(["doc_id", "part"])
    every = d.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    return every.repartition(n, "part").sortWithinPartitions("part", F.desc("ghost"), "known", "doc_id", F.xxhash64("text"))


def _ranged(bounds: list[float]):
    """Binary search over many bounds as nested conditions, so that the plan stays in generated code."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN doc_id <= {int(bounds[mid])} THEN {tree(lo, mid)} ELSE {tree(mid + 1, hi)} END"

    return F.expr(f"CAST({tree(0, len(bounds))} AS INT)")


DIGEST = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_digest(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document."""

    def work(batches):
        part, last, last_parts = None, "", None
        for b in batches:
            out = []
            for k, doc, known, text, ghost in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "known", "text", "ghost")), strict=True):
                own = chunks(text.encode())
                if not ghost:
                    if k != part:  # nothing follows
                        last, last_parts = "", {}
                    edited = replace_tail(text, last).encode()
                    e = chunks(edited)
                    out.append((doc if known else None, len(text), hashlib.sha256(edited).hexdigest(), encode(own), encode(e), likeness(own, e), likeness(own, last_parts)))
                part, last, last_parts = k, text, own
            names = [x.split()[0] for x in DIGEST.split(", ")]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return with_next(docs).select("part", "doc_id", "known", "text", "ghost").mapInArrow(work, DIGEST)
