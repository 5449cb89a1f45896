"""A training-data pipeline over the operators of docloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A runner may write each stage's rows and read them again as the next one's docs.

 - language: documents whose language is not one of the learned ones go: no letters at all (`und`), or
   a best score under LEAST_SCORE. The model fits on this stage's own input.
 - lines: blocks of lines aligned with an earlier document go; a document that loses all its text goes.
 - near: of each component of documents with 5-word Jaccard similarity 0.75 or more the first stays.
 - benchmark: documents that a benchmark item contaminates go.
 - packing: the rest is packed into sequences of LENGTH tokens; a row for each piece.

Defined results: an empty table gives an empty result of the same columns at each stage. Rows with a null text leave at
the first stage. Rows that repeat a doc_id stand or fall together in `near` and `benchmark`; rows with a null doc_id
are never copies. Texts are read whole, however long. Extra columns come back as they were, whatever their
names; n_chars follows a text that lines have left. Of ties the document with the least doc_id stays, and
documents that differ in none of them (repeated rows) stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import op1_ngram_join, op2_packing, op6_language, op8_line_dedup, op9_decontaminate
from docloom.llm.common import cut, quoted
from docloom.llm.queries import tokenizer

LEAST_SCORE, LENGTH = 0.3, 1024


def _plain(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with extra columns under names that no operator uses, and the selection that undoes that."""
    own = [c if c in ("doc_id", "text", "lang", "n_chars") else f"__extra_{k}" for k, c in enumerate(docs.columns)]
    plain = docs.select(*[F.col(quoted(c)).alias(o) for c, o in zip(docs.columns, own, strict=True)])
    return plain, [F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, back = _plain(docs)
    found = op6_language.predict(docs, op6_language.fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, back = _plain(docs)
    return op8_line_dedup.dedup_lines(docs, drop_empty=True).select(*back)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_ngram_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), any_case=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_packing.best_fit(docs, tokenizer(), LENGTH)


STAGES = [("language", language), ("lines", lines), ("near", near), ("benchmark", benchmark), ("packing", packing)]

#: The classifier, patience diff and byte-pair encoding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
