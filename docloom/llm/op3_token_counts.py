"""Edit-aware token counts.

Method. A byte-level BPE merges within pre-tokens only, so a text's count is the sum of its pre-tokens'
counts. A document keeps its pre-tokens in blocks of leaves (lengths and counts), and segment trees of sums over
the blocks. An edit replaces a range of characters: pre-tokens that it touches, and as many around it as the
pattern can look past, are split and encoded again until a boundary meets an old one; their blocks' leaves are
replaced (a block that grows too large is split) and the sums above them updated. All other blocks stay as they
are: their text is not read, and nothing of them is encoded.

`build_state` writes such documents as rows, `apply_edits` takes them and a table of edits to the next state;
`count_edits` does both in one pass, without a state in between.

Defined results: null texts are empty and have no token; an edit beyond the text's end is clipped to it. Repeated
rows count each on its own, and each gets its doc_id's edits; a null doc_id is never edited by apply_edits. An
empty table gives no rows; texts are read whole, however long. Extra columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters left of a boundary that the pattern's contractions and look-ahead can depend on.
CONTEXT = 4
#: Pre-tokens of a block, and pre-tokens whose counts a worker keeps.
LEAVES, KNOWN = 128, 1 << 18


class Counter:
    """Pre-tokens and their token counts for a tiktoken rank file; counts of frequent ones are kept."""

    def __init__(self, ranks: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, int] = {}
        self.encoded = 0

    def count(self, pre: str) -> int:
        n = self.known.get(pre)
        if n is None:
            n = len(self.encoding.encode_ordinary(pre)) if len(pre) > 1 or ord(pre[0]) > 127 else 1
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[pre] = n
        return n

    def counts(self, pres: list[str]) -> np.ndarray:
        self.encoded += len(pres)
        return np.fromiter(map(self.count, pres), np.int64, len(pres))


@lru_cache(maxsize=4)
def counter(ranks: str, pattern: str) -> Counter:
    return Counter(ranks, pattern)


class SumTree:
    """A segment tree of sums in one array; leaves beyond the items are 0."""

    def __init__(self, leaves: np.ndarray):
        size = 1 << max(0, int(len(leaves) - 1).bit_length())
        self.n, self.size = len(leaves), size
        self.t = np.zeros(2 * size, np.int64)
        self.t[size : size + len(leaves)] = leaves
        while size > 1:
            self.t[size // 2 : size] = self.t[size : 2 * size : 2] + self.t[size + 1 : 2 * size : 2]
            size //= 2

    @property
    def total(self) -> int:
        return int(self.t[1])

    def assign(self, at: int, leaves: np.ndarray) -> None:
        """Replace leaves at..at+len and the sums above them."""
        lo, hi = at + self.size, at + self.size + len(leaves)
        self.t[lo:hi] = leaves
        while lo > 1 and hi > lo:
            lo, hi = lo // 2, (hi + 1) // 2
            self.t[lo:hi] = self.t[2 * lo : 2 * hi : 2] + self.t[2 * lo + 1 : 2 * hi : 2]

    def locate(self, target: int) -> int:
        """The most leaves whose sum is at most target."""
        if target >= self.total:
            return self.n
        i = 1
        while i < self.size:
            i *= 2
            if self.t[i] <= target:
                target -= int(self.t[i])
                i += 1
        return i - self.size

    def prefix(self, k: int) -> int:
        """Sum of the first k leaves."""
        out, i = 0, k + self.size
        if k >= self.n:
            return self.total
        while i > 1:
            if i % 2:
                out += int(self.t[i - 1])
            i //= 2
        return out


class Block:
    """Some neighbouring pre-tokens: their text, lengths and token counts."""

    __slots__ = ("chars", "text", "tokens")

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray):
        self.text, self.chars, self.tokens = text, chars, tokens


def blocks_of(text: str, chars: np.ndarray, tokens: np.ndarray) -> list[Block]:
    """One block, or blocks of LEAVES pre-tokens if there are more than twice as many."""
    m = len(chars)
    if m <= 2 * LEAVES:
        return [Block(text, chars, tokens)] if m else []
    cuts = np.arange(0, m, LEAVES)
    ends = np.concatenate([[0], np.cumsum(chars)])
    at = [*cuts.tolist(), m]
    return [Block(text[ends[a] : ends[b]], chars[a:b], tokens[a:b]) for a, b in zip(at, at[1:], strict=False)]


class LeafTree:
    """Blocks of leaves under segment trees of how many leaves, characters and tokens each has."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks
        self._sum()

    def _sum(self) -> None:
        rows = np.array([self._row(b) for b in self.blocks], np.int64).reshape(-1, 3)
        self.leaves, self.chars, self.tokens = (SumTree(rows[:, k]) for k in range(3))

    @staticmethod
    def _row(b: Block) -> tuple[int, int, int]:
        return len(b.chars), len(b.text), int(b.tokens.sum())

    @property
    def n(self) -> int:
        return self.leaves.total

    def replace(self, i: int, j: int, new: list[Block]) -> None:
        """Blocks i..j give way to new ones; with as many, only the sums above them change."""
        if i == j and not new:
            return
        self.blocks[i:j] = new
        if len(new) != j - i:
            self._sum()
            return
        for tree, values in zip((self.leaves, self.chars, self.tokens), zip(*map(self._row, new), strict=True), strict=True):
            tree.assign(i, np.array(values, np.int64))

    def prefix(self, k: int) -> int:
        """Tokens of the first k leaves."""
        i = self.leaves.locate(k)
        own = self.blocks[i].tokens[: k - self.leaves.prefix(i)].sum() if i < len(self.blocks) else 0
        return self.tokens.prefix(i) + int(own)


class Document:
    """A text with the tree over its pre-tokens."""

    def __init__(self, text: str, by: Counter):
        self.by = by
        self.tree = LeafTree(blocks_of(text, *self._encoded(by.pattern.findall(text))))

    @classmethod
    def stored(cls, blocks: list[dict], by: Counter) -> Document:
        """A document from its state: nothing is split or encoded."""
        d = cls("", by)
        d.tree = LeafTree([Block(b["text"], np.array(b["chars"], np.int32), np.array(b["tokens"], np.int32)) for b in blocks])
        return d

    def state(self) -> list[dict]:
        return [{"text": b.text, "chars": b.chars, "tokens": b.tokens} for b in self.tree.blocks]

    def _encoded(self, pres: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter(map(len, pres), np.int32, len(pres)), self.by.counts(pres).astype(np.int32)

    @property
    def text(self) -> str:
        return "".join(b.text for b in self.tree.blocks)

    @property
    def total(self) -> int:
        return self.tree.tokens.total

    def edit(self, start: int, end: int, new: str) -> tuple[int, int]:
        """Replace text[start:end]; returns (the new total, pre-tokens encoded again)."""
        tree, blocks = self.tree, self.tree.blocks
        n = tree.chars.total
        start, end = min(max(0, start), n), min(max(start, end), n)
        low = max(0, start - CONTEXT)
        i = min(tree.chars.locate(low), max(0, len(blocks) - 1))
        j = min(len(blocks), tree.chars.locate(max(end - 1, low)) + 2)
        base = tree.chars.prefix(i)
        start, end, low, shift = start - base, end - base, low - base, len(new) - (end - start)
        while True:
            old = "".join(b.text for b in blocks[i:j])
            chars = np.concatenate([b.chars for b in blocks[i:j]]) if blocks[i:j] else np.zeros(0, np.int32)
            bounds = np.concatenate([[0], np.cumsum(chars)])
            text = old[:start] + new + old[end:]
            first = max(0, int(np.searchsorted(bounds, low, "right")) - 1)
            first = min(first, len(chars))
            pres, last = [], None
            for m in self.by.pattern.finditer(text, int(bounds[first])):
                a = m.start()
                if a - shift >= end and a >= start + len(new):
                    k = int(np.searchsorted(bounds, a - shift))
                    if k < len(chars) and bounds[k] == a - shift:
                        last = k
                        break
                pres.append(m.group())
            if last is not None or j == len(blocks):
                break
            j = min(len(blocks), i + 2 * (j - i))  # no boundary has met an old one yet: look further
        last = len(chars) if last is None else last
        fresh = self._encoded(pres)
        # Only blocks up to the one with the last replaced leaf change.
        ends = np.cumsum([len(b.chars) for b in blocks[i:j]]) if blocks[i:j] else np.zeros(0, np.int64)
        r = int(np.searchsorted(ends, max(last, first + 1))) + 1 if len(ends) else 0
        r = min(r, j - i)
        stop = int(ends[r - 1]) if r else 0
        tokens = np.concatenate([b.tokens for b in blocks[i : i + r]]) if r else np.zeros(0, np.int32)
        kept = text[: int(bounds[stop]) + shift]
        merged = [np.concatenate([x[:first], f, x[last:stop]]) for x, f in zip((chars, tokens), fresh, strict=True)]
        tree.replace(i, i + r, blocks_of(kept, *merged))
        return self.total, len(pres)


BLOCKS = "blocks array<struct<text:string,chars:array<int>,tokens:array<int>>>"
STATE = f"doc_id bigint, n_pretokens bigint, n_tokens bigint, n_reencoded bigint, {BLOCKS}"
_ROW = pa.schema([
    *[(c, pa.int64()) for c in ("doc_id", "n_pretokens", "n_tokens", "n_reencoded")],
    ("blocks", pa.list_(pa.struct([("text", pa.string()), ("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))]))),
])


def _rows(found: list[tuple[int | None, Document, int]]) -> pa.RecordBatch:
    ids, docs, again = zip(*found, strict=True) if found else ([], [], [])
    values = [list(ids), [d.tree.n for d in docs], [d.total for d in docs], list(again), [d.state() for d in docs]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _ROW, strict=True)], schema=_ROW)


def build_state(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Each document with its leaves (STATE); n_reencoded is what it took, all of them. Write it, and edit what was written."""

    def work(batches):
        by = counter(ranks, pattern)
        for b in batches:
            found = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                d = Document(text or "", by)
                found.append((doc, d, d.tree.n))
            yield _rows(found)

    return docs.select("doc_id", "text").mapInArrow(work, STATE)


def apply_edits(state: DataFrame, edits: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The state after edits (doc_id, pos, start, end, new), a document's by pos: each sees the text that those
    before it have left. Documents without edits pass by untouched, with n_reencoded 0."""
    named = F.struct("pos", "start", "end", F.coalesce("new", F.lit("")).alias("new"))
    by_doc = edits.where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(named)).alias("edits"))
    own = state.select("doc_id", "n_pretokens", "n_tokens", F.lit(0).cast("bigint").alias("n_reencoded"), "blocks")

    def work(batches):
        by = counter(ranks, pattern)
        for b in batches:
            found = []
            for doc, blocks, todo in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                d = Document.stored(blocks, by)
                found.append((doc, d, sum(d.edit(e["start"], e["end"], e["new"])[1] for e in todo)))
            yield _rows(found)

    changed = own.join(by_doc, "doc_id").select("doc_id", "blocks", "edits").mapInArrow(work, STATE)
    return own.join(by_doc, "doc_id", "left_anti").unionAll(changed)


COUNTS = "doc_id bigint, n_pretokens bigint, n_tokens bigint, edited_tokens bigint, n_reencoded bigint"


def count_edits(docs: DataFrame, edits, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, edited_tokens, n_reencoded. edits(doc_id, text) gives (start, end, new) triples."""

    def work(batches):
        by = counter(ranks, pattern)
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                d = Document(text or "", by)
                row = [doc, d.tree.n, d.total]
                again = sum(d.edit(*e)[1] for e in edits(doc, text or ""))
                out.append((*row, d.total, again))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in COUNTS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(work, COUNTS)


def middle_edit(doc_id: int | None, text: str) -> list[tuple[int, int, str]]:
    """The registered query's edits: seven characters of the middle go, and the document's number comes at a third."""
    n = len(text)
    return [(n // 2, n // 2 + 7, ""), (n // 3, n // 3, f" {doc_id}'s ")]
