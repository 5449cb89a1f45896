"""Benchmark decontamination by template canonicalisation.

Method. Words are canonicalised: numbers, names (capitalised words) and units after a number become
typed placeholders, other words lose case and punctuation. Each window of WINDOW template words of a
benchmark item (an item with fewer words is one window, from LEAST words on) is hash-joined with the
windows of all documents. For a document and item that share windows, the slots' values are compared:
within one item, a slot value must always map to the same value of the document, and back. Consistent
windows count; a document is contaminated by an item if consistent windows cover at least `coverage`
of the item's words. So a re-parameterised question (other numbers, other names) is caught, while a
text that only shares a template with shuffled values is not.

A slot may change its number of words: windows also meet with a number and its separators, and a run of
names, as one placeholder each. Windows of alignments close to that with the most windows (by half of the
item's words, or WINDOW) count together if they keep the item's order.

With any_case (as the queries have it) windows also meet as case-folded words, in which only numbers and
units are placeholders; a window counts if either form matches. So a copy in upper or lower case, whose
names can't be told by their written case, is found as well.

The benchmark's windows are kept in each task while they are at most KEPT (a checked bound); beyond it,
windows of both sides meet in a shuffled hash join. Both forms give the same rows.

Defined results: null or empty texts and items match nothing; a row with a null doc_id is matched like any
other and keeps the null; repeated rows and items match each on their own. Of alignments with as many windows
the one that starts first in the text counts. Empty tables give no rows. Extra columns are not read by
matches, and clean returns them as they are. Long texts are read whole.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, U, byte_table, cut, mix, prefix_sums, quoted, slices, small_batches, spans_hash, utf8, windows_hash, word_spans

WINDOW, LEAST, KEPT, BITS = 8, 5, 2_000_000, 1 << 23
#: Units that become a placeholder after a number.
UNITS = "mm cm m km g kg t ml l s ms min h hr hours hour days day years year mph % percent usd eur gbp pln dollars dollar euros euro cents cent miles mile feet foot inches inch pounds pound kilometers meters grams liters degrees".split()

_TABLE = byte_table(fold_case=True, seed=29)
#: Punctuation is no part of a template word; it separates nothing that white space doesn't, but % is a word.
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x25), *range(0x26, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: Code points of upper or title case.
_CAPITAL = np.array([chr(c).isupper() or chr(c).istitle() for c in range(1 << 16)])
#: Within a number; and what ends a run of names.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b".,'/:")] = True
_BREAK = ~SPACE
_BREAK[list(b"-'")] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
NUM, NAME, UNIT = (mix(np.array([k], U))[0] for k in (101, 102, 103))


def _bare(raw: np.ndarray) -> np.ndarray:
    """Punctuation blanked, which keeps positions."""
    out = raw.copy()
    out[_PUNCT[raw]] = 0x20
    return out


def _words(raw: np.ndarray, off: np.ndarray):
    """doc_words of template words: without punctuation, and with each % as a word of its own."""
    percent = np.flatnonzero(raw == 0x25)
    cuts = np.sort(np.concatenate([off, percent, percent + 1])) if len(percent) else off
    s, e, h = word_spans(_bare(raw), _TABLE, cuts)
    first = np.searchsorted(s, off[:-1], "left")
    return s, e, h, first, np.searchsorted(s, off[1:], "left") - first


def _capitals(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the characters that start at these places are of upper or title case."""
    b = [raw[np.minimum(at + k, len(raw) - 1)].astype(np.int64) for k in range(3)]
    two, three = (b[0] & 0x1F) << 6 | b[1] & 0x3F, (b[0] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F
    return _CAPITAL[np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, 0)))]


def _unit_hashes() -> np.ndarray:
    return np.sort(np.array([_words(a, np.array([0, len(a)]))[2][0] for a in (np.frombuffer(u.encode(), np.uint8) for u in UNITS)], U))


_UNITS = _unit_hashes()


class Form(NamedTuple):
    """Template hashes, slots (and which are names), each token's first word and words, and each text's first token and count."""

    t: np.ndarray
    slot: np.ndarray
    name: np.ndarray
    at: np.ndarray
    n: np.ndarray
    first: np.ndarray
    count: np.ndarray


class Words(NamedTuple):
    """Words of many texts: exact (case-folded) hashes, values (a number's words have that of the whole
    number), each text's first word and count, and the forms."""

    h: np.ndarray
    value: np.ndarray
    first: np.ndarray
    count: np.ndarray
    forms: list[Form]


def _joined(t, slot, name, join, first, count) -> Form:
    """Words as tokens; join tells whether a word belongs to the token of the word before it."""
    at = np.flatnonzero(~join)
    start = np.searchsorted(at, first)
    return Form(t[at], slot[at], name[at], at, np.diff(np.append(at, len(t))), start, np.searchsorted(at, first + count) - start)


def templates(column, any_case: bool = False) -> Words:
    """The words of a column of texts, with names as placeholders, and with any_case also as folded words."""
    raw, off = utf8(column)
    s, e, h, first, count = _words(raw, off)
    if not len(s):
        z = np.zeros(0, bool)
        return Words(h, h, first, count, [_joined(h, z, z, z, first, count)] * (4 if any_case else 2))
    if any_case and (raw >= 0x80).any():
        # Other letters than A-Z; lower case keeps white space and punctuation, and so the words.
        low, low_off = utf8(pc.utf8_lower(column))
        h = _words(low, low_off)[2]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
    number = digits[e] > digits[s]
    name = _capitals(raw, s)
    t = h.copy()
    unit = np.zeros(len(s), bool)
    units = _UNITS[np.minimum(np.searchsorted(_UNITS, h), len(_UNITS) - 1)] == h
    unit[1:] = number[:-1] & units[1:]
    per = np.zeros(len(s), bool)  # km/h is one unit
    per[1:] = unit[:-1] & units[1:] & (s[1:] == e[:-1] + 1) & (raw[e[:-1]] == 0x2F)
    unit |= per
    t[name], t[unit], t[number] = NAME, UNIT, NUM
    name &= ~(number | unit)
    inside = np.ones(len(s), bool)
    inside[first[first < len(s)]] = False
    numbers, names, apart = np.zeros((3, len(s)), bool)
    numbers[1:] = number[1:] & number[:-1] & (s[1:] == e[:-1] + 1) & _SEPARATOR[raw[e[:-1]]]
    numbers &= inside
    solid, ends = (np.concatenate([[0], np.cumsum(x)]) for x in (_BREAK[raw], raw == 0x0A))
    names[1:] = name[1:] & name[:-1] & (solid[s[1:]] == solid[e[:-1]]) & (ends[s[1:]] - ends[e[:-1]] < 2)
    names &= inside
    per &= inside
    numbers |= per
    at = np.flatnonzero(~numbers)
    n = np.diff(np.append(at, len(s)))
    value = np.repeat(np.where(n > 1, spans_hash(prefix_sums(h), at, at + n), h[at]), n)
    forms = [_joined(t, number | name | unit, name, x, first, count) for x in (apart, numbers | names)]
    if any_case:
        t = h.copy()
        t[unit], t[number] = UNIT, NUM
        forms += [_joined(t, number | unit, apart, x, first, count) for x in (apart, numbers)]
    return Words(h, value, first, count, forms)


class Bench:
    """The benchmark's windows by form: hash to (item, position), with each item's exact words and slots."""

    def __init__(self, rows: list[tuple[int, str]], any_case: bool = False):
        words = templates(pa.array([t for _, t in rows], pa.large_string()), any_case)
        self.any_case, self.words = any_case, words
        self.ids = [i for i, _ in rows]
        self.index = [self._index(form) for form in words.forms]
        self.widths = [sorted({int(min(WINDOW, c)) for c in form.count if c >= LEAST}) for form in words.forms]

    def _index(self, form: Form) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        H, A, K = [], [], []
        for k, (f, c) in enumerate(zip(form.first, form.count, strict=True)):
            if c < LEAST:
                continue
            w = min(WINDOW, int(c))
            x = windows_hash(form.t[f : f + c], w)
            H.append(x)
            A.append(f + np.arange(len(x)))
            K.append(np.full(len(x), k))
        cat = lambda x, d: np.concatenate(x) if x else np.zeros(0, d)
        hashes, token, item = cat(H, U), cat(A, np.int64), cat(K, np.int64)
        order = np.argsort(hashes, kind="stable")
        return hashes[order], token[order], item[order]

    def hits(self, words: Words, d: int, all_windows: list[dict[int, np.ndarray]]):
        """(token of the text, item, token of the item, width, form) of each shared window of text d."""
        out = []
        for k, ((hashes, token, item), windows) in enumerate(zip(self.index, all_windows, strict=True)):
            first, count = int(words.forms[k].first[d]), int(words.forms[k].count[d])
            for w in self.widths[k]:
                if count < w:
                    continue
                x = windows[w][first : first + count - w + 1]
                lo, hi = np.searchsorted(hashes, x, "left"), np.searchsorted(hashes, x, "right")
                for i in np.flatnonzero(hi > lo):
                    out += [(first + int(i), int(item[j]), int(token[j]), w, k) for j in range(lo[i], hi[i]) if min(WINDOW, self.words.forms[k].count[item[j]]) == w]
        return out


def consistent(pairs: list[tuple[int, int]], there: dict[int, int], back: dict[int, int]) -> bool:
    """Whether the slots' values map one to one together with those seen so far (which then grow)."""
    new_there, new_back = {}, {}
    for a, b in pairs:
        if there.get(a, new_there.get(a, b)) != b or back.get(b, new_back.get(b, a)) != a:
            return False
        new_there[a], new_back[b] = b, a
    there |= new_there
    back |= new_back
    return True


def slot_pairs(a: Words, b: Words, x: Form, y: Form, i: int, j: int, w: int, head: int, tail: int) -> list:
    """The slots' values of an item's window (tokens from i on) and a text's (from j on). A run of names at
    the item's first or last word (head, tail) may go on in the text beyond the item."""
    out = []
    for k in np.flatnonzero(x.slot[i : i + w]):
        p, q, n, m = int(x.at[i + k]), int(y.at[j + k]), int(x.n[i + k]), int(y.n[j + k])
        if not x.name[i + k]:
            out.append((int(a.value[p]), int(b.value[q])))
            continue
        if m > n and p == head:
            q, m = q + m - n, n
        elif m > n and p + n == tail:
            m = n
        u, v = a.h[p : p + n].tolist(), b.h[q : q + m].tolist()
        out += zip(u, v, strict=True) if n == m else [(tuple(u) if n > 1 else u[0], tuple(v) if m > 1 else v[0])]
    return out


def judge(bench: Bench, words: Words, hits) -> list[tuple[int, int, float, bool]]:
    """(item, consistent windows, share of the item's words covered, exact) for each item hit.

    Windows are taken diagonal by diagonal (one alignment of item and text), the fullest alignment of
    an item first, and then those close to it, as a question stands in a text as one passage.
    """
    by = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    own = bench.words
    for j, item, i, w, k in hits:
        x, y = own.forms[k], words.forms[k]
        p, q = int(x.at[i]), int(y.at[j])
        if p == own.first[item] and x.name[i]:
            q += max(0, int(y.n[j]) - int(x.n[i]))
        by[item][q - p][p, q].append((k, i, j, w))
    out = []
    for item, diagonals in by.items():
        best, seen = (0, 0.0, False), set()
        f, n = int(own.first[item]), int(own.count[item])
        near, order = max(WINDOW, n // 2), sorted(diagonals)
        for d in sorted(diagonals, key=lambda x: -len(diagonals[x])):
            if d in seen and len(diagonals[d]) <= best[0]:
                continue
            close = order[bisect_left(order, d - near) : bisect_right(order, d + near)]
            seen.update(close)
            there: dict = {}
            back: dict = {}
            covered = np.zeros(n, bool)
            taken: list[tuple[int, int]] = []
            used, exact = set(), True
            for c in sorted(close, key=lambda x: abs(x - d)):
                for (p, q), windows in sorted(diagonals[c].items()):
                    at = bisect_left(taken, (p, q))
                    again = at < len(taken) and taken[at] == (p, q)
                    if not again and ((at and (taken[at - 1][0] == p or taken[at - 1][1] >= q)) or (at < len(taken) and (taken[at][0] == p or taken[at][1] <= q))):
                        continue
                    fits = False
                    for k, i, j, w in windows:
                        x = own.forms[k]
                        pairs = slot_pairs(own, words, x, words.forms[k], i, j, w, f, f + n)
                        if consistent(pairs, there, back):
                            fits = True
                            exact &= all(u == v for u, v in pairs)
                            covered[p - f : int(x.at[i + w - 1] + x.n[i + w - 1]) - f] = True
                    if fits:
                        taken.insert(at, (p, q))
                        used.add(c)
            if len(taken) > best[0]:
                best = (len(taken), float(covered.mean()), exact and len(used) == 1)
        if best[0]:
            out.append((item, *best))
    return out


MATCHES = "doc_id bigint, item_id bigint, n_windows bigint, coverage double, exact boolean"


def _batch(b) -> pa.Table:
    return pa.Table.from_batches([b])


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, any_case: bool = False) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, exact: one row for each document and item that contaminates it.

    any_case: find copies in another case too."""
    small_batches(docs.sparkSession)
    items = benchmark.where("text is not null").select("item_id", "text")
    # A bound on the windows before anything is collected: characters / 2 words at most.
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    if size // 2 > KEPT:
        return _shuffled(docs, items, coverage, any_case)
    rows = sorted((r["item_id"], r["text"]) for r in items.collect() if r["item_id"] is not None)
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def work(batches):
        bench = Bench(shared.value, any_case)
        for b in batches:
            for part in slices(_batch(b)):
                yield _judged(bench, part, coverage)

    return docs.select("doc_id", "text").mapInArrow(work, MATCHES)


def _judged(bench: Bench, part: pa.Table, coverage: float) -> pa.RecordBatch:
    words = templates(part.column("text"), bench.any_case)
    windows = [{w: windows_hash(form.t, w) for w in widths} for form, widths in zip(words.forms, bench.widths, strict=True)]
    # Most texts share no window: look at all windows of the slice at once first.
    maybe = np.zeros(len(words.count), bool)
    for (hashes, _, _), form, by_width in zip(bench.index, words.forms, windows, strict=True):
        ends = form.first + form.count
        for w, x in by_width.items():
            at = np.searchsorted(hashes, x)
            found = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == x)
            doc = np.searchsorted(ends, found, "right")
            inside = doc < len(ends)
            maybe[doc[inside][found[inside] + w <= ends[doc[inside]]]] = True
    out, ids = [], part.column("doc_id").to_pylist()
    for d in np.flatnonzero(maybe):
        for item, n, share, exact in judge(bench, words, bench.hits(words, int(d), windows)):
            if share >= coverage:
                out.append((ids[d], bench.ids[item], n, share, exact))
    cols = list(zip(*out, strict=True)) if out else [[]] * 5
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], ["doc_id", "item_id", "n_windows", "coverage", "exact"])


def _shuffled(docs: DataFrame, items: DataFrame, coverage: float, any_case: bool) -> DataFrame:
    """The same for a benchmark of any size: window hashes of both sides meet in a hash join, which
    gives (row, item_id) candidates; each candidate's texts are then judged in one task row. A bitmap of
    fixed size keeps most other windows of the documents out of the shuffle."""
    d = docs.where("text is not null").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))

    def hashed(df: DataFrame, key: str, least_only: bool, bits=None) -> DataFrame:
        def work(batches):
            for b in batches:
                for part in slices(_batch(b)):
                    forms = templates(part.column("text"), any_case).forms
                    ids, keys, hashes = part.column(key).to_numpy(), [], []
                    for w, form in product(range(LEAST, WINDOW + 1), forms):
                        x = windows_hash(form.t, w)
                        for i, (f, c) in enumerate(zip(form.first, form.count, strict=True)):
                            if c >= w and (not least_only or min(c, WINDOW) == w):
                                own = np.unique(x[f : f + c - w + 1])
                                if bits is not None:
                                    slot = own & U(BITS - 1)
                                    own = own[bits.value[slot >> U(5)] >> (slot & U(31)).astype(np.uint32) & np.uint32(1) == 1]
                                hashes.append(own)
                                keys.append(np.full(len(own), ids[i]))
                    k = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                    v = np.concatenate(hashes) if hashes else np.zeros(0, U)
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(v.view(np.int64), pa.int64())], [key, "h"])

        return df.select(key, "text").mapInArrow(work, f"{key} bigint, h bigint")

    asked = cut(hashed(items.where("item_id is not null"), "item_id", True))
    slot = F.col("h").bitwiseAND(F.lit(BITS - 1))
    words = asked.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("b"))
    bits = np.zeros(BITS // 32, np.int64)
    for r in words.collect():  # at most BITS / 32 rows
        bits[r["w"]] = r["b"]
    shared = docs.sparkSession.sparkContext.broadcast(bits.astype(np.uint32))
    pairs = hashed(d, "row", False, shared).join(asked, "h").select("row", "item_id").distinct()
    full = pairs.join(d, "row").join(items.select("item_id", F.col("text").alias("item")), "item_id")

    def work(batches):
        for b in batches:
            rows = _batch(b)
            for k in range(rows.num_rows):
                one = rows.slice(k, 1)
                yield _judged(Bench([(one.column("item_id")[0].as_py(), one.column("item")[0].as_py())], any_case), one, coverage)

    return full.select("doc_id", "text", "item_id", "item").mapInArrow(work, MATCHES)


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, any_case: bool = False) -> DataFrame:
    """The documents without those that an item contaminates; rows with a null doc_id stay."""
    found = matches(docs.select("doc_id", "text"), benchmark, coverage, any_case).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*map(quoted, docs.columns))
