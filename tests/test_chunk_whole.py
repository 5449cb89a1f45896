"""chunk_pages against brute force, with lines over the budget."""

import random

from docloom import catalog
from docloom.operators.chunk import budgets


def split(t, budget):
    out = []
    while len(t) > budget:
        window = t[:budget]
        cut = max(window.rfind("\n\n"), window.rfind("\n"), window.rfind(". "))
        at = cut + 1 if cut > budget / 2 else budget
        out.append(t[:at])
        t = t[at:]
    return [*out, t] if t or not out else out


def count(pages, budget):
    n = chars = 0
    for x in (x for t in pages for x in split(t, budget)):
        if n == 0 or chars + len(x) > budget:
            n, chars = n + 1, 0
        chars += len(x)
    return n


def test_chunk_pages(spark, tmp_path):
    r = random.Random(6)
    line = lambda n: "".join(r.choice("abc. é") for _ in range(n))
    texts = [None, "", "short", "\n".join(line(3000) for _ in range(9)), line(4000), line(4001), line(24647), "x" * 9000, line(3500) + "\n" + line(5200) + "\n\n" + line(100), line(60000) + "\n" + line(9000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: (x["budget"], x["chunks"]) for x in catalog.QUERIES["chunk_pages"](spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        pages = [] if t is None else t.split("\n")
        assert got[k] == next((b, count(pages, b)) for b in budgets(4000) if count(pages, b) <= 4)
    assert len(got) == len(texts)
