"""Operators 2, 3, 4, 6, 7 and 9 on small inputs, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import op2_packing, op3_token_counts, op4_fingerprint, op6_language, op7_url_filter, op9_decontaminate

P = pytest.importorskip("public_tokenizers")
BPE, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


# ------------------------------------------------------------------ 2


def brute_best_fit(sizes, length):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, room in enumerate(bins) if room >= s]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= s
        else:
            bins.append(length - s)
    return len(bins)


def test_plan_is_best_fit():
    r = random.Random(4)
    for _ in range(200):
        length = r.choice([10, 64, 100])
        sizes = [r.randint(1, length) for _ in range(r.randint(0, 60))]
        histogram = {s: sizes.count(s) for s in set(sizes)}
        rows = op2_packing.plan(histogram, length)
        held = {}
        for size, rank, ranks, first, offset in rows:
            for k in range(ranks):
                held.setdefault(first + k, []).append((offset, size))
        assert sum(len(v) for v in held.values()) == len(sizes)
        for v in held.values():
            at = 0
            for offset, size in sorted(v):
                assert offset == at
                at += size
            assert at <= length
        assert len(held) == brute_best_fit(sizes, length)


@pytest.mark.parametrize("length", [64, 1024])
def test_packing(docs, rows, length):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    got = op2_packing.best_fit(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), BPE, length).toPandas()
    known = {r["doc_id"]: r["text"] for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()}
    assert set(got.doc_id) == set(known)
    for doc, own in got.groupby("doc_id"):
        ids = np.array([*t.encode(known[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        own = own.sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(ids)
        assert len(own) == 1 or (own.length.iloc[1:] == length).all()
        for x in own.itertuples():
            assert zlib.crc32(ids[x.start : x.start + x.length].tobytes()) == x.ids_crc32
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= length
    assert got.sequence_id.nunique() == brute_best_fit(got.length.tolist(), length)


def test_packing_empty(empty):
    assert op2_packing.best_fit(empty, BPE).collect() == []


# ------------------------------------------------------------------ 3


def test_edits_match_a_full_count():
    by = op3_token_counts.Counter(RANKS, P.PATTERN)
    r = random.Random(1)
    for _ in range(1500):
        letters = r.choice(["ab '\n", "ab1 's.é\t", "'resvltdm  x\n1"])
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        d = op3_token_counts.Document(text, by)
        for _ in range(3):
            a = r.randint(0, len(text))
            b = r.randint(a, min(len(text), a + 6))
            new = "".join(r.choice(letters) for _ in range(r.randint(0, 5)))
            d.edit(a, b, new)
            text = text[:a] + new + text[b:]
            pres = by.pattern.findall(text)
            assert d.text == text and d.total == len(by.encoding.encode_ordinary(text))
            assert d.tree.n == len(pres) and d.tree.prefix(len(pres) // 2) == sum(by.counts(pres[: len(pres) // 2]))


def test_few_are_encoded_again():
    by = op3_token_counts.Counter(RANKS, P.PATTERN)
    d = op3_token_counts.Document("word other " * 5000, by)
    assert d.edit(20000, 20004, "thing")[1] < 8


def test_count_edits(docs, rows, empty):
    by = op3_token_counts.Counter(RANKS, P.PATTERN)
    got = op3_token_counts.count_edits(docs.withColumn("n_tokens", F.lit(0)), op3_token_counts.middle_edit, RANKS, P.PATTERN).collect()

    def edited(doc, t):
        for a, b, new in op3_token_counts.middle_edit(doc, t):
            t = t[:a] + new + t[b:]
        return t

    count = lambda t: len(by.encoding.encode_ordinary(t))
    want = sorted(((i, count(t or ""), count(edited(i, t or ""))) for i, t, *_ in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_tokens"], r["edited_tokens"]) for r in got), key=repr) == want
    assert op3_token_counts.count_edits(empty, op3_token_counts.middle_edit, RANKS, P.PATTERN).collect() == []


# ------------------------------------------------------------------ 4


def test_fingerprints(docs, empty):
    known = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in op4_fingerprint.edited_digest(known.withColumn("part", F.lit(1))).collect()}
    order = sorted(((r["doc_id"], r["text"] or "") for r in known.collect()), reverse=True)
    assert len(got) == len(order)
    by_text = {}
    for k, (doc, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        r = got[doc]
        a, b, c = (op4_fingerprint.chunks(x.encode()) for x in (text, edited, following))
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == op4_fingerprint.encode(a) and r["edited_fingerprint"] == op4_fingerprint.encode(b)
        assert op4_fingerprint.decode(r["fingerprint"]) == a
        assert r["near_edited"] == op4_fingerprint.likeness(a, b) and r["near_next"] == op4_fingerprint.likeness(a, c)
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert op4_fingerprint.edited_digest(empty).collect() == []


def test_one_row_and_repeated_rows(spark, docs, rows):
    one = spark.createDataFrame([(1, "abc" * 100)], "doc_id bigint, text string")
    assert [(r["near_next"]) for r in op4_fingerprint.edited_digest(one).collect()] == [1.0]
    assert op4_fingerprint.edited_digest(docs).count() == len(rows)
    assert [r["doc_id"] for r in op4_fingerprint.edited_digest(docs.where("doc_id is null")).collect()] == [None]


def test_chunks_survive_a_shift():
    r = np.random.default_rng(1)
    data = r.integers(97, 122, 20000, np.uint8).tobytes()
    a, b = op4_fingerprint.chunks(data), op4_fingerprint.chunks(b"prefix" + data)
    assert op4_fingerprint.likeness(a, b) > 0.95
    ends = np.diff([0, *op4_fingerprint.boundaries(np.frombuffer(data, np.uint8))])
    assert ends[:-1].min() >= op4_fingerprint.LEAST and ends.max() <= op4_fingerprint.MOST and 64 < ends.mean() < 192
    h = op4_fingerprint.gear(np.frombuffer(data[:200], np.uint8))
    assert int(h[150]) == sum(int(op4_fingerprint.GEAR[data[150 - j]]) << j for j in range(32)) % 2**32


# ------------------------------------------------------------------ 6

SYLLABLES = {"xx": "ka ro mi tu sel", "yy": "ße ün der sch ö", "zz": "ción ñor que ll ía"}


def spoken(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language_held_out(spark, empty):
    r = random.Random(2)
    rows = [(k, spoken(r, lang, r.randint(3, 120)), lang, "s") for k, lang in enumerate(r.choice(list(SYLLABLES)) for _ in range(600))]
    rows += [(1000, None, "xx", "s"), (1001, "", None, "s"), (1002, "123 -- !", "yy", "s"), (1003, spoken(r, "xx", 40000), None, "s")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string").repartition(3)
    model = op6_language.fit(d)
    assert model.classes == sorted(SYLLABLES)
    got = {x["doc_id"]: x for x in op6_language.predict(d.withColumn("held_out", op6_language.held_out()), model).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    held = [x for k, x in got.items() if x["held_out"] and k < 1000]
    assert len(held) > 80 and sum(x["lang"] == x["lang_pred"] for x in held) / len(held) > 0.97
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003]["lang_pred"] == "xx" and all(0 <= x["score"] <= 1 for x in got.values())
    assert op6_language.fit(empty) is None
    assert [x["lang_pred"] for x in op6_language.predict(d.limit(2), None).collect()] == ["und"] * 2
    assert op6_language.predict(empty, model).collect() == []


def test_tables_equal_the_network():
    net = op6_language.Net(["a", "b"])
    x = op6_language.windows("Ala ma kota, żółw też. ".encode() * 40)
    emb = net.e[x]
    pooled = []
    for k in op6_language.WIDTHS:
        m = op6_language.WINDOW - k + 1
        pooled.append((sum(emb[:, j : j + m] @ net.w[k][j] for j in range(k)) + net.b[k]).max(1))
    z = np.maximum(np.concatenate(pooled, 1), 0) @ net.v + net.c
    want = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(net.tables().log_probs(x), want, atol=1e-4)


# ------------------------------------------------------------------ 7


def test_rules(spark):
    urls = [
        ("http://a.example.org/en/12", "a.example.org", "/en/12", "example.org/en/1", "block"), ("http://EXAMPLE.org/es/x?q", "example.org", "/es/x", "example.org/es/", "block"),
        ("https://x.org/", "x.org", "/", "org/", "allow"), ("https://x.org", "x.org", "", None, "allow"), ("http://b.com/fr/#t", "b.com", "/fr/", "com/fr/", "allow"), ("http://com/de/9", "com", "/de/9", "com/de/", "block"),
        ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("a://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("x://h?a=http://y.com/de/", "h", "", None, "allow"), ("", "", "", None, "allow"),
    ]
    d = spark.createDataFrame([(k, u[0], 1) for k, u in enumerate(urls)] + [(99, "https://x.org/", 2)], "page_id bigint, url string, host int")
    got = {r["page_id"]: tuple(r)[1:5] for r in op7_url_filter.judge(d, None).collect()}
    assert [got[k] for k in range(len(urls))] == [u[1:] for u in urls] and got[99] == got[2]
    assert op7_url_filter.judge(d.limit(0), None).collect() == []


def test_templates_and_purity(spark):
    rows, labels = [], []
    for k in range(400):
        section = ("news", "spam", "blog", "rare")[0 if k % 2 else 1 if k % 4 else 2]
        rows.append((k, f"http://h.net/{section}/{k}"))
        if k % 3 == 0:
            labels.append((k, 0.0 if section == "spam" else 1.0))
    rows += [(1000, "http://h.net/new/1"), (1001, "http://other.net/new/1")]
    labels += [(5, None), (None, 1.0)]
    out = {r["page_id"]: r for r in op7_url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, good double")).collect()}
    for k, u in rows[:400]:
        assert out[k]["verdict"] == ("block" if "/spam/" in u else "allow")
    assert out[1000]["template"] == "/**" and out[1001]["verdict"] == "allow"
    plan = op7_url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string"), None)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


# ------------------------------------------------------------------ 9

ITEM = "If Anna buys 12 apples for 30 euros and sells 5 of them to Mark, how many apples does she still have left over"


def test_decontamination(spark, monkeypatch):
    filler = "some other words that stand before and after the question in this text"
    other = ITEM.replace("Anna", "Olga").replace("Mark", "Ivan").replace("12", "77").replace("30", "41").replace(" 5 ", " 9 ").replace("euros", "pounds")
    mixed = ITEM.replace("Anna buys 12 apples", "Anna buys 3 apples").replace("Mark", "Anna")
    docs = [(1, f"{filler} {ITEM} {filler}"), (2, f"{filler} {other}! {filler}"), (3, filler), (4, None), (5, ""), (6, " ".join(ITEM.split()[:9]) + " " + filler), (7, ITEM.upper()), (8, filler * 3000 + " " + ITEM), (9, "short item has five words"), (9, ITEM), (10, mixed), (None, ITEM)]
    bench = [(1, ITEM), (2, "short item has five words"), (3, None), (4, ""), (5, "a b"), (6, ITEM)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")
    b = b.withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): r for r in op9_decontaminate.matches(d, b).collect()}
    assert {k for k in got if k[0] is not None} == {(k, i) for k in (1, 2, 8, 9, 10) for i in (1, 6)} | {(9, 2)}
    # two names became one: the windows that hold both are not consistent
    assert got[10, 1]["n_windows"] < got[1, 1]["n_windows"] and got[10, 1]["coverage"] < 1.0
    assert 10 not in {r["doc_id"] for r in op9_decontaminate.matches(d, b, coverage=0.97).collect()}
    assert got[1, 1]["exact"] and not got[2, 1]["exact"] and got[2, 1]["coverage"] == 1.0
    assert sorted(r["doc_id"] for r in op9_decontaminate.clean(d, b).collect() if r["doc_id"] is not None) == [3, 4, 5, 6, 7]
    monkeypatch.setattr(op9_decontaminate, "KEPT", 1)  # the shuffled form
    again = {(r["doc_id"], r["item_id"], r["n_windows"]) for r in op9_decontaminate.matches(d, b).collect()}
    assert again == {(k[0], k[1], r["n_windows"]) for k, r in got.items()}
    assert op9_decontaminate.matches(d.limit(0), b).collect() == [] and op9_decontaminate.matches(d, b.limit(0)).collect() == []
