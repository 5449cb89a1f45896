"""Operator 8 on lines of more than a hundred distinct texts."""

import pytest

from docloom.llm import op8_line_dedup


@pytest.mark.parametrize("n", [90, 110, 250])
def test_frequent_line_beside_a_rare_one(spark, n):
    """The answer for a document doesn't depend on how many others hold its line."""
    shared = "a passage that all of the texts hold"
    rows = [(k, f"own line of the text {k}\n{shared}") for k in range(n)]
    rows.append((n, f"own line of the text 7\n{shared}\nnothing else"))  # one rare line beside it
    rows.append((n + 1, "a line held by this and one more\nown words"))
    rows.append((n + 2, f"{shared}\nits own\na line held by this and one more"))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in op8_line_dedup.dedup_lines(d).collect()}
    assert got[0] == (rows[0][1], 0)
    assert all(got[k] == (f"own line of the text {k}", 1) for k in range(1, n))
    assert got[n] == ("nothing else", 2) and got[n + 2] == ("its own", 2)
