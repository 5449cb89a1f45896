"""Tables in buckets: joins and groups within a key's part take no shuffle."""

from pyspark.sql import functions as F

from docloom.durable import clustered, joins_by_part


def test_clustered_tables_meet_without_a_shuffle(spark):
    a = clustered(spark.range(50).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")), "k")
    b = clustered(spark.range(30).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"), F.lit(1).alias("w")), "k")
    with joins_by_part(spark):
        both = a.join(b.hint("merge"), ["k", "v"]).groupBy("k", "v").agg(F.sum("w").alias("w"))
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert both.count() == 30
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_small_files_of_many_rows_are_not_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")
    was = [spark.conf.get(key, None) for key in keys]
    a = clustered(spark.range(50000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")), "k")
    b = clustered(spark.range(50000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"), F.lit("as one").alias("w")), "k")
    with joins_by_part(spark):
        plan = a.join(b, ["k", "v"])._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert "Exchange" not in plan
    assert [spark.conf.get(key, None) for key in keys] == was
