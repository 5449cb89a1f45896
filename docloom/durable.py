"""Tables that end a lineage: written below the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session that has none gets a folder of its own, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        found = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found}/docloom-{spark.sparkContext.applicationId}"


def durable(df: DataFrame) -> DataFrame:
    """df as a written table: later steps read it, whatever becomes of the executors that made it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def joins_by_part(spark: SparkSession):
    """Here tables that are dealt by one column of a join's keys are joined as they are, and none is broadcast for the size of its files: few
    bytes of a file may be many rows. What a shuffle has measured is still broadcast below the session's threshold."""
    conf, small, measured = spark.conf, "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    here = {"spark.sql.requireAllClusterKeysForCoPartition": "false", small: "-1", measured: conf.get(measured, None) or conf.get(small)}
    was = {key: conf.get(key, None) for key in here}
    for key, value in here.items():
        conf.set(key, value)
    try:
        yield
    finally:
        for key, value in was.items():
            conf.unset(key) if value is None else conf.set(key, value)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key as `clustered` tables are; no shuffle where it is dealt so already."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def clustered(df: DataFrame, key: str) -> DataFrame:
    """As `durable`, in buckets of key: groups and windows of such tables by key, or by key and more columns, take no shuffle, nor
    do joins that are planned in `joins_by_part`."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt(df, key).write.format("parquet").bucketBy(n, key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(f"docloom_{name}")
    return spark.table(f"docloom_{name}")
