"""Fill-in-the-middle against a plain version, and back again."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from docloom.llm import op11_fill_middle as op


def brute(doc, text, seed=7, rate=100, spm=50):
    text = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if text == "" or any(m in text for m in op.MARKERS) or h3 % 100 >= rate:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["\n", "\n\n\n", "a\n", "\na", "<", "a<\nS>\n<M", "x<P>y", "żół\r\nw\x00\n😀\n", "<<\n<<S\n", None, "", "one line"]


@pytest.mark.parametrize("args", [{}, {"rate": 40, "spm": 90, "seed": 3}])
def test_fill(spark, rows, args):
    known = rows + [(9000 + k, t, None, None, None) for k, t in enumerate(ODD * 4)] + [(5, "line\n" * 300_000, None, None, None)]
    d = spark.createDataFrame(known, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({"N": F.lit("gone"), "Restored": F.lit(1), "k": F.monotonically_increasing_id(), "odd `name`.x": F.lit(2.5)})
    filled = op.restore(op.fill_in_middle(d, **args))
    assert filled.columns == ["doc_id", "text", "lang", "source", "n_chars", "k", "odd `name`.x", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = filled.collect()
    assert len(got) == len(known)
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], r["text"], **args)
        assert r["restored"] == (r["text"] or "") and r["odd `name`.x"] == 2.5
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_empty_and_markers(spark, empty):
    assert op.restore(op.fill_in_middle(empty)).collect() == []
    for bad in [("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "bc", "x")]:
        with pytest.raises(ValueError):
            op.fill_in_middle(empty, markers=bad)
    other = spark.createDataFrame([(k, f"a {k}\n<P> b\nlast") for k in range(20)], "doc_id bigint, text string")
    got = op.restore(op.fill_in_middle(other, unit=r"\S+\s*|\s+", markers=("[pre]", "[suf]", "[mid]")), markers=("[pre]", "[suf]", "[mid]")).collect()
    assert all(r["restored"] == r["text"] and r["form"] != "plain" and r["n"] == 5 for r in got)
