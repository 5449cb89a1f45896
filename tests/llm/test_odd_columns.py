"""Extra columns with clashing or odd names, null doc_ids on both paths, units."""

from pyspark.sql import functions as F

from docloom.llm import op1_ngram_join, op8_line_dedup, op9_decontaminate

ITEM = "if the bus drives at 40 km/h for 12 hours and then stops at 30 % of the way how far from home is it by noon"


def test_line_dedup_columns(spark):
    d = spark.createDataFrame([(1, "a shared line of text\nown one", "x"), (2, "a shared line of text\nown two", "y")], "doc_id bigint, text string, source string")
    odd = d.withColumns({f"x{k}": F.lit(k) for k in range(5)}).withColumnsRenamed({"x0": "__gone", "x1": "__left", "x2": "__line_key", "x3": "a.b", "x4": "N_Removed"})
    out = op8_line_dedup.dedup_lines(odd)
    assert out.columns == ["doc_id", "text", "source", "__gone", "__left", "__line_key", "a.b", "n_lines", "n_removed"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[2]["text"] == "own two" and got[2]["n_removed"] == 1 and [got[2][c] for c in ("__gone", "__left", "__line_key", "a.b")] == [0, 1, 2, 3]
    assert op1_ngram_join.keep_one(odd).columns == odd.columns


def test_benchmark_units(spark, monkeypatch):
    docs = [
        (1, ITEM.replace("40 km/h", "55 mph").replace("30 %", "45%")), (2, ITEM.replace("30 %", "60 percent")), (None, "before " + ITEM), (None, None), (3, "nothing of it"),
        (4, "Łukasz Ząb and Ωmega Δelta buy 12 apples in the shop"),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(1, ITEM), (2, "Żaneta Ołów and Αlpha Βeta buy 75 apples in the shop"), (None, "no item")], "item_id bigint, text string")
    got = sorted(map(tuple, op9_decontaminate.matches(d, b).collect()), key=repr)
    assert {(i, k) for i, k, *_ in got} == {(1, 1), (2, 1), (None, 1), (4, 2)} and all(c == 1.0 for *_, c, _ in got)
    assert {(i, x) for i, _, _, _, x in got} == {(1, False), (2, False), (None, True), (4, False)}
    monkeypatch.setattr(op9_decontaminate, "KEPT", 1)  # the shuffled form
    assert sorted(map(tuple, op9_decontaminate.matches(d, b).collect()), key=repr) == got


def test_url_filter_ties(spark):
    from docloom.llm import op7_url_filter

    long = "http://h.net/" + "/".join(f"s{k}" for k in range(400)) + "/x" * 3000
    pages = spark.createDataFrame([(1, "http://a.net/x/1"), (2, "http://a.net/x/1"), (3, None), (4, long), (5, "http://b.net/p"), (5, "http://b.net/p")], "page_id bigint, url string")
    labels = spark.createDataFrame([(5, 1.0, "a", 1), (5, 0.0, "b", 2), (4, None, "c", 3), (None, 1.0, "d", 4)], "page_id bigint, good double, host string, n int")
    rules = [("allow", "net/x"), ("block", "net/x"), ("block", "nothing/")]
    got = sorted(((r["page_id"], r["verdict"], r["rule"]) for r in op7_url_filter.judge(pages.withColumn("path", F.lit(1)), labels, rules).collect()), key=repr)
    assert got == [(1, "block", "net/x"), (2, "block", "net/x"), (3, "allow", None), (4, "allow", None), (5, "allow", None), (5, "allow", None)]
    assert op7_url_filter.judge(pages.limit(0), labels).collect() == []


def test_language_columns(spark):
    from docloom.llm import op6_language

    d = spark.createDataFrame([(1, "some words", "en"), (1, "some words", "en"), (2, None, "en"), (None, "", None)], "doc_id bigint, text string, lang string")
    odd = d.select("*", F.lit(1).alias("a `quoted`.name"), F.lit("x").alias("Score"))
    got = op6_language.predict(odd, None)
    assert got.columns == ["doc_id", "text", "lang", "a `quoted`.name", "lang_pred", "score"]
    assert sorted((r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in got.collect()) == [(0, "und", 0.0), (1, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0)]
    assert op6_language.predict(odd.limit(0), None).collect() == []
