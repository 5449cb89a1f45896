"""Grounding of claimed values in the text that they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.values import collect_dates, collect_numbers, grounding_status, to_cents


def number_index(docs: DataFrame) -> DataFrame:
    """doc_id, cents: every number in the documents' text."""
    return docs.select("doc_id", F.explode(collect_numbers(F.col("text"))).alias("cents"))


def date_index(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(collect_dates(F.col("text"))).alias("date"))


def no_scans() -> Column:
    return F.array().cast("array<int>")


def ground_amounts(claims: DataFrame, docs: DataFrame, scans: Column | None = None) -> DataFrame:
    """claims (doc_id, value, page) with status. The text's numbers stay one array a document, so that
    one join on doc_id does, and nothing is exploded."""
    index = docs.select("doc_id", collect_numbers(F.col("text")).alias("__numbers"))
    found = F.coalesce(F.array_contains("__numbers", to_cents(F.col("value"))), F.lit(False))
    status = grounding_status(found, no_scans() if scans is None else scans, F.col("page"))
    return claims.join(index, "doc_id", "left").withColumn("status", status).drop("__numbers")


def ground_dates(claims: DataFrame, docs: DataFrame, scans: Column | None = None) -> DataFrame:
    index = docs.select("doc_id", collect_dates(F.col("text")).alias("__dates"))
    found = F.coalesce(F.array_contains("__dates", F.col("date")), F.lit(False))
    status = grounding_status(found, no_scans() if scans is None else scans, F.col("page"))
    return claims.join(index, "doc_id", "left").withColumn("status", status).drop("__dates")


def unsupported(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """Claims whose value the text does not have: an anti join on (doc_id, cents)."""
    c = claims.withColumn("cents", to_cents(F.col("value")))
    return c.join(number_index(docs), ["doc_id", "cents"], "left_anti")
