"""Operator 9 on slots that change their number of words."""

from docloom.llm import op9_decontaminate

ITEM = "if John sells 980 of the red apples in the first week then the shop owner Mark pays 4 dollars for each of them before noon"


def test_slots_of_several_words(spark):
    other = ITEM.replace("John", "Mary Ann").replace("980", "1,250").replace("Mark", "Lee Van Cleef").replace(" 4 ", " 3.50 ")
    plain = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    w = plain.split()
    longer = " ".join([*w[:9], "really", "quite", *w[9:]])
    docs = [(1, "before it " + other + " after"), (2, longer), (3, " ".join([*w[10:], *["other"] * 3, *w[:6]])), (4, "Dr. Smith went home")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(1, ITEM), (2, plain)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in op9_decontaminate.matches(d, b).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 2)}
    assert got[1, 1]["coverage"] == 1.0 and not got[1, 1]["exact"]
    assert got[2, 2]["coverage"] == 1.0 and not got[2, 2]["exact"]
    assert got[3, 2]["coverage"] == 0.5
