"""Registered queries of references that are looked up in their fragment. Part of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.catalog import SQL_GROUNDED, amount_claims, query, statements
from docloom.operators import cite


@query(f"SELECT id AS doc_id, status = 'grounded' AS ok, CASE WHEN status = 'grounded' THEN NULL ELSE '{cite.NO_AMOUNT}' END AS message FROM {SQL_GROUNDED}")
def reference_lists(spark: SparkSession, d: str) -> DataFrame:
    """Every order's claimed amount as a reference into its statement."""
    claims = amount_claims(spark, d).select("doc_id", "value")
    null = F.lit(None)
    refs = claims.select("doc_id", F.lit(0).alias("chunk_id"), F.lit("amount").alias("kind"), F.lit(0).alias("pos"), "value", F.lit("PLN").alias("currency"), null.cast("string").alias("date"), F.lit(1).alias("page"))
    pieces = statements(spark, d).select("doc_id", F.lit(0).alias("chunk_id"), F.lit(1).alias("page"), F.lit(0).alias("pos"), "text")
    lists = cite.parse_references(refs, pieces)
    return lists.select("doc_id", F.col("items").isNotNull().alias("ok"), F.get("issues", F.lit(0))["message"].alias("message"))
