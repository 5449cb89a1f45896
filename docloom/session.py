"""Session defaults shared by tests, the benchmark and applications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", partitions: int = 8, name: str = "docloom") -> SparkSession:
    """A session with UTC, AQE and the given number of shuffle partitions."""
    return (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key over as many tasks as a shuffle has, or two a core if that is more: work that costs far more than its rows weigh must not depend on how
    few parts a file has."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, key)
