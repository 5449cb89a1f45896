"""Few texts out of many: found by a bitmap within the JVM, whatever the ids."""

from docloom.llm import op1_ngram_join
from docloom.llm.common import small_batches


def test_few_texts_are_found_without_a_pass_through_python(spark):
    rows = [(k, f"text {k}") for k in range(2000)] + [(7, "again"), (None, "none"), (-5, "below"), (2**62, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = spark.createDataFrame([(7, 0), (7, -1), (1999, 3), (-5, 0), (2**62, 1), (5000, 1)], "doc_id bigint, salt int")
    found = op1_ngram_join.some_texts(docs, ids)
    want = [(7, "text 7", 0), (7, "text 7", -1), (7, "again", 0), (7, "again", -1), (1999, "text 1999", 3), (-5, "below", 0), (2**62, None, 1)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    everything = op1_ngram_join.some_texts(docs, docs.where("doc_id is not null").select("doc_id").distinct())
    assert everything.count() == 2003
    assert op1_ngram_join.some_texts(docs, ids.limit(0)).count() == 0


def test_batches_are_small_unless_the_session_says_otherwise(spark):
    arrow = "spark.sql.execution.arrow"
    own = spark.newSession()
    small_batches(own)
    assert own.conf.get(f"{arrow}.maxRecordsPerBatch") == "1000"
    assert own.conf.get(f"{arrow}.maxBytesPerBatch").rstrip("b") == str(4 << 20)
    assert own.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "512"
    told = spark.newSession()
    told.conf.set(f"{arrow}.maxRecordsPerBatch", "300")
    small_batches(told)
    assert told.conf.get(f"{arrow}.maxRecordsPerBatch") == "300"
