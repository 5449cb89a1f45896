"""Operators 1, 5, 8 and 10 against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import exchange, op1_ngram_join, op5_substring_dedup, op8_line_dedup, op10_suffix_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPACES.split(t or "") if w]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def clash(docs):
    """Extra columns with the names that operators use inside."""
    return docs.withColumns({c: F.lit(7) for c in ("chunk", "bucket", "n", "k1", "component_id", "part", "slot", "lines", "whole", "gone", "key")})


# ------------------------------------------------------------------ 1


def shingle_set(t):
    w = words((t or "").translate(LOWER))
    return frozenset(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    """component of each row, with doc_ids as nodes."""
    known = [(i, shingle_set(t)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in known}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x in range(len(known)):
        for y in range(x):
            (i, s), (j, t) = known[x], known[y]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(shingle_set(t)), None if i is None else find(i) if shingle_set(t) else i) for i, t, *_ in rows if i is not None)


def test_jaccard_components(docs, rows):
    got = op1_ngram_join.jaccard_components(clash(docs)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == brute_components(rows)
    assert [(r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None] == [(26, None)]
    assert len(got) == len(rows)


def test_jaccard_families_and_chains(spark):
    """A family of near copies around a base, a chain whose ends don't link, and pairs at the very bound."""
    r = random.Random(2)
    base = [f"w{k}" for k in range(200)]
    rows, k = [], 0
    for _ in range(40):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(200)] = f"v{r.randint(0, 9)}"
        rows.append((k, " ".join(w)))
        k += 1
    chain = [f"c{k}" for k in range(100)]
    for s in range(0, 60, 3):
        rows.append((k, " ".join([*chain[s:], *[f"d{j}" for j in range(s)]])))
        k += 1
    for n in range(5, 90):  # one text is the first n of the other's 100 words: Jaccard (n - 4) / 96
        rows.append((k, " ".join(f"e{n}_{j}" for j in range(100))))
        rows.append((k + 1, " ".join(f"e{n}_{j}" for j in range(n))))
        k += 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = op1_ngram_join.jaccard_components(docs).collect()
    assert sorted(tuple(x) for x in got) == brute_components(rows)


def test_jaccard_frequent_tokens(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(op1_ngram_join, "HEAVY", 1)  # every token counts as frequent
    got = op1_ngram_join.jaccard_components(docs).where("doc_id is not null").collect()
    assert sorted(tuple(x) for x in got) == brute_components(rows)


def test_keep_one(docs, rows):
    kept = op1_ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    first = {i for i, _, c in brute_components(rows) if i == c}
    assert {r["doc_id"] for r in kept.collect()} == first | {None}


# ------------------------------------------------------------------ 5


def brute_words(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            w = words(t)
            for a in range(len(w) - 12):
                k = tuple(w[a : a + 13])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - 12):
            if i is not None and first[tuple(w[a : a + 13])] < i:
                gone[a : a + 13] = [True] * 13
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [2000, 1 << 22])
def test_substrings(docs, rows, size, monkeypatch):
    monkeypatch.setattr(op5_substring_dedup, "sized_chunks", lambda d: exchange.sized_chunks(d, size))
    got = op5_substring_dedup.dedup_substrings(clash(docs), with_text=True).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == brute_words(rows)
    assert sum(r["n_removed"] for r in got) > 100
    for r in got:
        assert sha(r["kept"].encode()) == r["kept_sha256"] and sum(s["length"] for s in r["spans"]) == r["n_removed"]


# ------------------------------------------------------------------ 10


def brute_bytes(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            b = (t or "").encode()
            for a in range(len(b) - 49):
                first[b[a : a + 50]] = min(first.get(b[a : a + 50], i), i)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - 49):
            if i is not None and first[b[a : a + 50]] < i:
                gone[a : a + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, sha(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("size", "hot"), [(20000, 512), (20000, 2), (1 << 22, 512)])
def test_bytes(docs, rows, size, hot, monkeypatch):
    monkeypatch.setattr(op10_suffix_dedup, "sized_chunks", lambda d: exchange.sized_chunks(d, size))
    monkeypatch.setattr(op10_suffix_dedup, "HOT", hot)
    got = op10_suffix_dedup.dedup_bytes(clash(docs)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_bytes(rows)


def test_suffix_array():
    r = random.Random(3)
    for t in range(300):
        s = bytes(r.choice((b"ab", b"abcd", bytes(range(256)))[t % 3]) for _ in range(r.randint(0, 90)))
        order = op10_suffix_dedup.suffix_array(s)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        common = op10_suffix_dedup.adjacent_prefixes(np.frombuffer(s, np.uint8), order, 50)
        for k in range(1, len(s)):
            a, b = s[order[k] :], s[order[k - 1] :]
            n = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert common[k] == min(n, 50)


# ------------------------------------------------------------------ 8


def brute_lines(rows, rare):
    known = sorted({(i, t) for i, t, *_ in rows if i is not None and t is not None})
    rep = {}
    for i, t in known:
        rep.setdefault(t, i)
    texts = defaultdict(list)
    for t, i in rep.items():
        texts[i].append(t.split("\n"))
    owner, df = {}, Counter()
    for t, i in rep.items():
        for x in {x for x in t.split("\n") if len(x.strip(" ")) >= 8}:
            owner[x] = min(owner.get(x, i), i)
            df[x] += 1
    out = {}
    for i, t in known:
        ls = t.split("\n")
        if rep[t] != i:
            out[i, t] = ("", len(ls))
            continue
        near = [(owner[x], df[x] <= rare) for x in set(ls) if x in owner and owner[x] < i and df[x] > 1]
        if any(k for _, k in near):
            near = [x for x in near if x[1]]
        gone = {j for o, _ in set(near) for earlier in texts[o] for _, j in op8_line_dedup.patience(earlier, ls)}
        out[i, t] = ("\n".join(x for j, x in enumerate(ls) if j not in gone), len(gone))
    return sorted(((i, *(out[i, t] if (i, t) in out else (t, 0))) for i, t, *_ in rows), key=repr)


@pytest.mark.parametrize("rare", [100, 3])
def test_lines(docs, rows, rare):
    got = op8_line_dedup.dedup_lines(docs.withColumns({"n_removed": F.lit("x"), "lines": F.lit(1), "whole": F.lit(1)}), rare=rare).collect()
    assert sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in got), key=repr) == brute_lines(rows, rare)
    assert sum(r["n_removed"] for r in got) > 20


def test_patience():
    p = op8_line_dedup.patience
    assert p([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert p([1, 2, 3, 4], [9, 2, 8, 4, 7]) == [(1, 1), (3, 3)]
    assert p([], [1]) == [] and p([1, 1, 2], [1, 2, 2]) == [(0, 0), (2, 2)]
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randint(0, 8) for _ in range(r.randint(0, 12))] for _ in range(2))
        got = p(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


# ------------------------------------------------------------------ empty tables


def test_empty(empty):
    assert op1_ngram_join.jaccard_components(empty).collect() == []
    assert op5_substring_dedup.dedup_substrings(empty).collect() == []
    assert op8_line_dedup.dedup_lines(empty).collect() == []
    assert op10_suffix_dedup.dedup_bytes(empty).collect() == []
