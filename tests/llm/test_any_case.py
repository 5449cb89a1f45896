"""Operator 9 on copies of an item in another case."""

from docloom.llm import op9_decontaminate

ITEM = "If Anna buys 12 apples for 30 euros and sells 5 of them to Żaneta Ölmann, how many apples does Anna still have left over"


def test_any_case(spark, monkeypatch):
    other = ITEM.lower().replace("12", "77").replace("30", "41")
    shuffled = "how many words of this text stand in another order than those of the item Anna and Mark once wrote for us"
    docs = [(1, ITEM), (2, "before it " + ITEM.upper() + " and after"), (3, "before it " + ITEM.lower()), (4, other), (5, shuffled.upper()), (6, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in op9_decontaminate.matches(d, b, any_case=True).collect()}
    assert set(got) == {1, 2, 3, 4} and all(r["coverage"] == 1.0 for r in got.values())
    assert [got[k]["exact"] for k in (1, 2, 3, 4)] == [True, True, True, False]
    assert len({r["n_windows"] for r in got.values()}) == 1
    assert sorted(r["doc_id"] for r in op9_decontaminate.clean(d, b, any_case=True).collect()) == [5, 6]
    monkeypatch.setattr(op9_decontaminate, "KEPT", 1)  # the shuffled form
    assert {r["doc_id"]: r for r in op9_decontaminate.matches(d, b, any_case=True).collect()} == got
