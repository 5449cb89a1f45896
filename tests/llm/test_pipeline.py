"""The corpus pipeline: each stage, and all of them, against brute force on a small table."""

import random
import zlib

import pytest
from pyspark.sql import functions as F
from test_dedup import brute_components

import corpus_pipeline
from docloom.llm import op6_language

EXTRA = ("score", "lang_pred", "n_lines", "N_Removed", "a.b", "__gone", "component_id", "item_id", "chunk", "row")
WORDS = {
    "en": "the of and to in is that for it with as was on be at by this have from or one had not but what all were when we there can".split(),
    "pl": "nie się w na jest że do to z co jak ale po tak za od już tylko czy było przez być może ich kiedy bardzo także więc żeby".split(),
}
ITEM = "a farmer has twelve brown cows and buys seven more at the market how many brown cows does the farmer have in the end"


def table(seed=4):
    """(doc_id, text, lang) with copies, near copies, shared blocks, an item, and odd cases. A shared line stands once in a
    document and always in the same order."""
    r = random.Random(seed)
    rows = []
    say = lambda lang, n: " ".join(r.choice(WORDS[lang]) + (f" k{r.randint(0, 999)}" if r.random() < 0.3 else "") for _ in range(n))
    block = [say("en", 9) for _ in range(3)]
    for k in range(60):
        lang = "en" if k % 3 else "pl"
        own = [say(lang, r.randint(12, 30)) for _ in range(r.randint(1, 6))]
        at = r.randint(0, len(own))
        lines = [*own[:at], *(block if k % 7 == 0 else []), *own[at:]]
        rows.append([k * 2 + 1, "\n".join(lines), lang])
    for k in range(5):  # near copies on one line: no line is shared
        w = rows[k + 10][1].replace("\n", " ").split(" ")
        w[len(w) // 2] = f"changed{k}"
        rows.append([200 + k, " ".join(w), rows[k + 10][2]])
    rows += [[300, rows[3][1], "en"], [301, rows[3][1], None], [302, say("en", 40) + " " + ITEM, "en"], [303, ITEM.upper(), "en"], [304, say("en", 30000), "en"]]
    rows += [[305, None, "en"], [306, "", "en"], [307, " \n\t", None], [308, "1234 5678", None], [309, "ok", "en"], [None, rows[5][1] + " tail", "en"], [None, None, None]]
    rows += [list(rows[1]), list(rows[1])]  # repeated rows
    r.shuffle(rows)
    return [tuple(x) for x in rows]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, lang, f"s{k % 3}", None if t is None else len(t)) for k, (i, t, lang) in enumerate(table())], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.withColumns({f"x{k}": F.lit(100 + k) for k in range(len(EXTRA))}).withColumnsRenamed({f"x{k}": c for k, c in enumerate(EXTRA)}).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def kept(df, docs):
    """(doc_id, text) of a stage's rows, whose columns are those of documents with the extra values as they were."""
    assert df.schema.simpleString() == docs.schema.simpleString()
    rows = df.collect()
    for r in rows:
        assert [r[c] for c in EXTRA] == [100 + k for k in range(len(EXTRA))]
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(x):
    return sorted(x, key=repr)


def test_language(spark, documents, sf_dir):
    got = kept(corpus_pipeline.language(spark, documents, sf_dir), documents)
    model = op6_language.fit(documents)
    rows = rows_of(documents)
    want = []
    for i, t in rows:
        if t is None or not any(c.isalpha() for c in t):
            continue
        w = op6_language.windows(t.encode())
        z = sum(model.log_probs(w[k : k + 1])[0].astype(float) for k in range(len(w))) / len(w)
        p = [2.718281828459045**x for x in z]
        if max(p) / sum(p) >= corpus_pipeline.LEAST_SCORE:
            want.append((i, t))
    assert got == same(want) and 309 in {i for i, _ in got}


def test_lines(spark, documents, sf_dir):
    got = kept(corpus_pipeline.lines(spark, documents, sf_dir), documents)
    rows = rows_of(documents)
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(x.strip(" ")) >= 8:
                first[x] = min(i, first.get(x, i))
    want = []
    for i, t in rows:
        if i is None or t is None:
            want.append((i, t))
            continue
        lines = t.split("\n")
        left = [x for x in lines if first.get(x, i) >= i]
        if any(j is not None and j < i and u == t for j, u in rows):
            left = []
        if len(left) == len(lines) or "".join(left).split():
            want.append((i, "\n".join(left)))
    assert got == same(want)


def test_near(spark, documents, sf_dir):
    got = kept(corpus_pipeline.near(spark, documents, sf_dir), documents)
    rows = rows_of(documents)
    leaves = {i for i, _, c in brute_components(rows) if i != c}
    assert got == same((i, t) for i, t in rows if i not in leaves) and {200, 204, 300, 301} <= leaves


def test_benchmark(spark, documents, sf_dir):
    got = kept(corpus_pipeline.benchmark(spark, documents, sf_dir), documents)
    item = ITEM.split()

    def share(t):
        w, covered = (t or "").lower().split(), set()
        windows = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        for k in range(len(item) - 7):
            if tuple(item[k : k + 8]) in windows:
                covered |= set(range(k, k + 8))
        return len(covered) / len(item)

    rows = rows_of(documents)
    assert got == same((i, t) for i, t in rows if share(t) < 0.5) and len(got) == len(rows) - 2


def test_packing_and_run(spark, documents, sf_dir):
    tokenizers = pytest.importorskip("tokenizers")
    from docloom.llm.queries import tokenizer

    docs, stages = documents, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near", "benchmark", "packing"]
    for name in list(stages)[:-1]:
        docs = spark.createDataFrame(stages[name](spark, docs, sf_dir).collect(), documents.schema)
    rows = rows_of(docs)
    encode = tokenizers.Tokenizer.from_file(tokenizer())
    want, lengths = [], []
    for i, t in rows:
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((i, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))))
            lengths.append(b - a)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert same(tuple(r[:5]) for r in got) == same(want)
    bins = []
    for n in sorted(lengths, reverse=True):  # best-fit decreasing, piece by piece
        fit = [k for k, room in enumerate(bins) if room >= n]
        if fit:
            bins[min(fit, key=lambda k: bins[k])] -= n
        else:
            bins.append(1024 - n)
    placed = {}
    for r in got:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in placed.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(placed) <= len(bins)


def test_empty_table(spark, documents, sf_dir):
    none = documents.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf_dir)
        assert out.collect() == []
        assert name == "packing" or out.columns == documents.columns
