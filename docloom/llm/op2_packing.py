"""Best-fit packing of token sequences.

Documents are tokenised, an end id is appended, longer ones are cut to pieces of the sequence length
(only the first piece may be shorter), and the pieces are packed by best-fit decreasing.

Method. Best-fit decreasing depends on the pieces' lengths only, and there are at most `length` of them.
So the driver gets the histogram of lengths (bounded by the sequence length, whatever the input), runs
best fit over it with a segment tree over remaining capacities, and the plan - ranges of ranks by length
- goes back as a small table. Pieces find their rank within their length by salted counts: no task sees
all pieces of a frequent length.

Defined results: null texts are empty (the end id alone); repeated rows, and rows with a null or the same doc_id, are packed
each on its own (pieces that are equal in all columns share their places among them); ties in length go in the
order of salts and then of doc_id, piece, start and checksum; an empty table gives no rows. Very long texts are
encoded whole. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, small_batches

#: A salt for about 2 ** SALTED pieces, so that the pieces of a length and salt are few, however many the input has.
LEAST_SALTS, SALTED = 64, 16
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_encoders: dict[str, object] = {}


#: Fixed value: the pattern of byte-level pre-tokens.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones are themselves, others in order from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain_ranks(file: dict) -> dict[bytes, int] | None:
    """Token bytes to ids, if the file is a plain byte-level BPE whose merges are numbered in their order, so that the least id
    is the merge that comes first; else None."""
    model, pre = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not (plain and level and file.get("normalizer") is None):
        return None
    byte, vocab = byte_of(), model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    single = {t for t in vocab if len(t) == 1}
    ids = [vocab.get(a + b, -1) for a, b in merges]
    if len(single) != 256 or len(single) + len(merges) != len(vocab) or ids != list(range(256, 256 + len(merges))):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items()}


class Encoder:
    """Ids of a tokenizers file. If the file is a plain byte-level BPE (`plain_ranks`), texts without added tokens
    get the same ids at a quarter of the time from the same vocabulary and merges in tiktoken's merge loop."""

    def __init__(self, path: str):
        import json
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.full = Tokenizer.from_file(path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            ranks = plain_ranks(json.load(f))
        self.fast = None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(x in text for x in self.special):
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()), dtype="<u4")
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """The pieces of each document; with_ids adds the ids themselves as an array."""

    small_batches(docs.sparkSession)

    def work(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(pa.Table.from_batches([batch])):
                out = defaultdict(list)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(enc.ids(text or ""), np.uint32(end_id)).astype("<u4")
                    head = len(ids) % length if len(ids) > length else len(ids)
                    cuts = [0, *range(head or length, len(ids) + 1, length)] if len(ids) > length else [0, len(ids)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        out["doc_id"].append(doc)
                        out["piece"].append(k)
                        out["start"].append(a)
                        out["length"].append(b - a)
                        out["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
                        if with_ids:
                            out["ids"].append(ids[a:b].astype(np.int32))
                fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
                if with_ids:
                    fields.append(("ids", pa.list_(pa.int32())))
                yield pa.RecordBatch.from_pydict({k: out[k] for k, _ in fields}, pa.schema(fields))

    return docs.select("doc_id", "text").mapInArrow(work, PIECES + (", ids array<int>" if with_ids else ""))


class CapacityTree:
    """A segment tree over remaining capacities 0..length: how many open bins have each."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity of an open bin that is need or more."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(histogram: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """(piece length, first rank, ranks, first sequence id, offset) by best-fit decreasing.

    Equal pieces are placed together: a run is a range of sequences with equal contents, so that the
    work depends on the number of lengths and runs, not of pieces.
    """
    tree, runs, out, ids = CapacityTree(length), defaultdict(list), [], 0
    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:  # open as many as hold the rest, full[i] of size each
                each = length // size
                full, rest = divmod(left, each)
                for bins, items in ((full, each), (1, rest)):
                    if bins and items:
                        for k in range(items):
                            out.append((size, rank, bins, ids, k * size))
                            rank += bins
                        free = length - items * size
                        runs[free].append((ids, bins))
                        tree.add(free, bins)
                        ids += bins
                break
            # The tightest bin stays the tightest while the size fits again: each is filled before the next.
            first, bins = runs[room].pop()
            each = min(room // size, left)
            took = min(left // each, bins)
            if took < bins:
                runs[room].append((first + took, bins - took))
            tree.add(room, -took)
            for k in range(each):
                out.append((size, rank, took, first, length - room + k * size))
                rank += took
            free = room - each * size
            runs[free].append((first, took))
            tree.add(free, took)
            left -= took * each
    return out


def pack(cut_pieces: DataFrame, length: int = 1024) -> DataFrame:
    """cut_pieces (doc_id, piece, length, ...) with sequence_id and offset. Reads its input three times."""
    spark = cut_pieces.sparkSession
    salts = max(LEAST_SALTS, cut_pieces.count() >> SALTED)
    p = cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = p.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    rows = plan(histogram, length)
    schema = "length bigint, rank bigint, ranks bigint, first bigint, offset bigint"
    # A few rows a length: a length's ranks are dealt to runs in ascending order.
    runs = spark.createDataFrame(rows, schema)
    by_length = runs.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("rank", "ranks", "first", "offset"))).alias("runs"))
    from pyspark.sql import Window as W

    before = F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")
    starts = counts.select("length", "salt", before.alias("before"))
    within = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = p.withColumn("within", within - 1).join(starts, ["length", "salt"])
    ranked = ranked.withColumn("r", F.col("before") + F.col("within")).join(F.broadcast(by_length), "length")
    run = F.element_at(F.filter("runs", lambda x: (x["rank"] <= F.col("r")) & (F.col("r") < x["rank"] + x["ranks"])), 1)
    ranked = ranked.withColumn("run", run)
    return ranked.select(*cut_pieces.columns, (F.col("run.first") + F.col("r") - F.col("run.rank")).alias("sequence_id"), F.col("run.offset").alias("offset"))


def best_fit(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    return pack(cut(pieces(docs, tokenizer, length, end_id)), length)
