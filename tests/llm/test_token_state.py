"""Operator 3's stored state, and packing of rows that doc_id does not tell apart."""

import random

import pytest

from docloom.llm import op2_packing, op3_token_counts

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")


def test_long_texts(monkeypatch):
    """Blocks split, shrink and vanish; each edit encodes its surroundings only."""
    monkeypatch.setattr(op3_token_counts, "LEAVES", 4)
    by, r = op3_token_counts.Counter(RANKS, P.PATTERN), random.Random(3)
    for _ in range(40):
        text = " ".join(r.choice(["word", "don't", "  ", "a1b2", "é", "\n\n"]) for _ in range(r.randint(0, 300)))
        d = op3_token_counts.Document(text, by)
        for _ in range(25):
            a = r.randint(0, len(text))
            b = min(len(text), a + r.choice([0, 1, 5, 200]))
            new = r.choice(["", " ", "x", "'s", "new words here " * r.randint(0, 20)])
            again = d.edit(a, b, new)[1]
            text = text[:a] + new + text[b:]
            pres = by.pattern.findall(text)
            assert d.text == text and d.total == sum(by.counts(pres)) and d.tree.n == len(pres)
            assert [int(x) for k in d.tree.blocks for x in k.chars] == [len(x) for x in pres]
            assert again <= len(by.pattern.findall(new)) + 200


def test_work_follows_the_edit():
    by = op3_token_counts.Counter(RANKS, P.PATTERN)
    text = "some words of a long text " * 20000
    d = op3_token_counts.Document(text, by)
    seen, kept = by.encoded, {id(b) for b in d.tree.blocks}
    d.edit(260_000, 260_005, "other")
    assert by.encoded - seen < 8 and len(kept - {id(b) for b in d.tree.blocks}) <= 2


def test_state(spark, docs, rows, empty):
    by = op3_token_counts.Counter(RANKS, P.PATTERN)
    state = op3_token_counts.build_state(docs, RANKS, P.PATTERN).cache()
    texts = lambda df: sorted((r["doc_id"], "".join(b["text"] for b in r["blocks"]), r["n_tokens"]) for r in df.collect() if r["doc_id"] is not None)
    count = lambda t: len(by.encoding.encode_ordinary(t))
    assert texts(state) == sorted((i, t or "", count(t or "")) for i, t, *_ in rows if i is not None)
    changed = [i for i, *_ in rows if i is not None][::7]
    edits = [(i, k, 3 * k, 3 * k + 2, "new ") for i in sorted(set(changed)) for k in range(3)] + [(None, 0, 0, 1, "x"), (changed[0], 9, 10**9, 10**9 + 5, None)]
    e = spark.createDataFrame(edits, "doc_id bigint, pos int, start int, end int, new string")
    out = op3_token_counts.apply_edits(state, e, RANKS, P.PATTERN)

    def edited(i, t):
        for j, _, a, b, new in edits:
            if j == i:
                t = t[:a] + (new or "") + t[b:]
        return t

    want = [(i, edited(i, t or "")) for i, t, *_ in rows if i is not None]
    assert texts(out) == sorted((i, t, count(t)) for i, t in want)
    got = out.collect()
    assert len(got) == len(rows) and all((r["n_reencoded"] > 0) == (r["doc_id"] in set(changed)) for r in got)
    assert op3_token_counts.apply_edits(op3_token_counts.build_state(empty, RANKS, P.PATTERN), e, RANKS, P.PATTERN).collect() == []


def test_packing_of_equal_rows(spark):
    """Null and repeated doc_ids, repeated rows, a clashing column; and a plan where a bin takes two pieces in turn."""
    rows = [(None, "a b c")] * 3 + [(1, "one two")] * 2 + [(1, "another"), (2, None), (None, None)]
    d = spark.createDataFrame([(*x, 7) for x in rows], "doc_id bigint, text string, salt int")
    got = op2_packing.best_fit(d, P.path("byte_bpe_50k.json"), 16).collect()
    assert len(got) == len(rows)
    placed = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    for (s, a, n), (t, b, _) in zip(placed, placed[1:], strict=False):
        assert b == a + n if s == t else b == 0
    assert len({first + k for *_, n, first, _ in op2_packing.plan({524: 10, 240: 4, 166: 24}, 1024) for k in range(n)}) == 10
    assert op2_packing.best_fit(d.limit(0), P.path("byte_bpe_50k.json"), 16).collect() == []
