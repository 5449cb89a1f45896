"""Order-preserving union and deduplication of what chunks report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import collapse, normalize_key
from docloom.functions.values import to_cents


def first_per_key(df: DataFrame, by: list[str], keys: list, pos: list[str], limit: int | None = None) -> DataFrame:
    """Rows that are the first of their key within by, in order of pos; at most limit of them.

    The first is a min_by aggregate (combined before the shuffle); only a limit needs a window, over
    the distinct rows.
    """
    named = {f"__k{i}": k for i, k in enumerate(keys)}
    rest = [c for c in df.columns if c not in by]
    first = df.withColumns(named).groupBy(*by, *named).agg(F.min_by(F.struct(*rest), F.struct(*pos)).alias("r"))
    out = first.select(*by, "r.*")
    if limit is None:
        return out
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*pos))
    return out.withColumn("__n", rank).where(F.col("__n") <= limit).drop("__n")


def unique_strings(df: DataFrame, by: list[str], text: str, pos: list[str], limit: int | None = None) -> DataFrame:
    """First spelling of each string, case- and space-insensitive; blank ones go."""
    d = df.withColumn(text, collapse(F.col(text))).where(F.col(text) != "")
    return first_per_key(d, by, [normalize_key(F.col(text))], pos, limit)


def unique_amounts(df: DataFrame, by: list[str], pos: list[str]) -> DataFrame:
    return first_per_key(df, by, [to_cents(F.col("value")), F.col("currency"), F.col("page"), normalize_key(F.col("context"))], pos)


def unique_dates(df: DataFrame, by: list[str], pos: list[str]) -> DataFrame:
    return first_per_key(df, by, [F.col("date"), F.col("page"), normalize_key(F.col("context"))], pos)
