"""What a client makes of answers, progress and errors, and how evaluated samples are judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom import schemas as S


def answer_error(aborted: Column, timed_out: Column, status: Column, body: Column, valid: Column) -> Column:
    """struct<source, code, request_id> of a failed request, null for a good one. status is null if no answer came: then an abort by the
    caller is no outcome (null, with `aborted` for the caller to look at), and does not count where an answer did come. An answer with an error
    is the API's if it has all that the contract asks for, a known code, a message and a request id. valid tells whether a good answer's body
    passed."""

    def error(source, code, request=None):
        return F.struct(F.lit(source).alias("source"), (code if isinstance(code, Column) else F.lit(code)).alias("code"), (F.lit(None).cast("string") if request is None else request).alias("request_id"))

    json = F.try_parse_json(body)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(json, f"$.error.{name}", "variant"))
    said = lambda name: F.when(kind(name) == "STRING", F.try_variant_get(json, f"$.error.{name}", "string"))
    issues = kind("issues")
    listed = issues.isNull() | issues.startswith("ARRAY")
    known = said("code").isin([c for c, *_ in S.ERRORS]) & said("message").isNotNull() & said("requestId").isNotNull() & listed
    return (
        F.when(status.isNull(), F.when(~F.coalesce(aborted, F.lit(False)), F.when(F.coalesce(timed_out, F.lit(False)), error("client", "TIMEOUT")).otherwise(error("client", "NETWORK"))))
        .when(json.isNull(), error("client", "INVALID_RESPONSE"))
        .when((status < 200) | (status > 299), F.when(F.coalesce(known, F.lit(False)), error("api", said("code"), said("requestId"))).otherwise(error("client", "UNKNOWN")))
        .when(~F.coalesce(valid, F.lit(False)), error("client", "INVALID_RESPONSE"))
    )


def progress_text(stage: Column, total: Column, page: Column, total_pages: Column) -> Column:
    """What is said of an inspection's progress; a null stage is before any."""
    # The texts.
    page_of = F.concat(F.lit("Odczyt obrazu na tym urządzeniu (OCR) · Strona "), F.coalesce(page, F.lit(0)).cast("string"), F.lit(" z "), F.coalesce(total_pages, F.lit(0)).cast("string"))
    tree = F.when(stage == "attachment", "Sprawdzanie drzewa załączników…").otherwise("Sprawdzanie struktury dokumentu…")
    return (
        F.when(stage.isNull(), "Otwieranie pliku…")
        .when(stage == "complete", "Kontrola dokumentu zakończona.")
        .when(total.isNull(), tree)
        .when(stage == "original", "Sprawdzanie oryginalnego obrazu osadzonego w PDF…")
        .when(stage == "attachment", "Odczyt załączników z pamięci zakończonej kontroli…")
        .otherwise(page_of)
    )


def with_messages(errors: DataFrame, dimension: DataFrame) -> DataFrame:
    """errors (source, code, ...) with the message of each; the dimension has a row for each source and code."""
    return errors.join(F.broadcast(dimension.select("source", "code", "message")), ["source", "code"], "left")


def single_file(files: DataFrame, code: Column) -> DataFrame:
    """files (drop_id, ...) of one drop each: drop_id, code. More than one file is refused before any is looked at."""
    per = files.groupBy("drop_id").agg(F.count("*").alias("n"), F.min(code).alias("own"))
    return per.select("drop_id", F.when(F.col("n") > 1, "MULTIPLE_FILES").otherwise(F.col("own")).alias("code"))


def same_set(expected: Column, observed: Column) -> Column:
    """Whether two arrays hold the same items, repeats and order aside."""
    return (F.size(F.array_except(expected, observed)) == 0) & (F.size(F.array_except(observed, expected)) == 0)


def all_passed(checks: DataFrame, by: list[str], passed: Column) -> DataFrame:
    """by, passed: whether every check of a sample passed."""
    return checks.groupBy(*by).agg(F.bool_and(passed).alias("passed"))


def drift(samples: DataFrame, by: list[str], order: list[str], value: str, edge: int = 10) -> DataFrame:
    """by, first_mean, last_mean: of a cohort's first and last samples. Either end is a rank of its own, so that each task
    gives no more than `edge` rows of a cohort to the shuffle."""

    def end(orders, name):
        ranked = samples.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(*orders)))
        return ranked.where(F.col("__k") <= edge).groupBy(*by).agg(F.avg(value).alias(name))

    return end(order, "first_mean").join(end([F.desc(c) for c in order], "last_mean"), by)


def remove_from_history(entries: DataFrame, removed: DataFrame, scope: str, key: str) -> DataFrame:
    """History entries without those that a scope has removed."""
    return entries.join(removed.select(scope, key).distinct(), [scope, key], "left_anti")
