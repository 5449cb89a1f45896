"""The registered queries of this subpackage: thin digests over the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_ngram_join, op2_packing, op3_token_counts, op4_fingerprint, op5_substring_dedup, op6_language, op7_url_filter, op8_line_dedup, op9_decontaminate, op10_suffix_dedup
from . import op11_fill_middle, op12_nearest, op13_whitening

from .oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_packing.best_fit(_table(spark, sf_dir, "documents"), tokenizer())


def op3_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return op3_token_counts.count_edits(docs, op3_token_counts.middle_edit, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_fingerprint.edited_digest(_table(spark, sf_dir, "documents"))


def op5_substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents")).drop("spans")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    asked = docs.select("doc_id", "text", op6_language.held_out().alias("held_out"))
    found = op6_language.predict(asked, op6_language.fit(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score")


#: The document number in a page's address.
PAGE_DOC = r"^[^?#]*/([0-9]+)(?:\.[A-Za-z]+)?/?(?:[?#].*)?$"


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    doc = F.regexp_extract("url", PAGE_DOC, 1).try_cast("bigint")
    good = (F.col("quality") * (1 - F.col("toxic"))).cast("double")
    known = pages.select("page_id", doc.alias("doc_id")).join(labels.select("doc_id", good.alias("good")), "doc_id")
    return op7_url_filter.judge(pages, known.select("page_id", "good"))


def op8_line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op8_line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), any_case=True)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_suffix_dedup.dedup_bytes(_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = op11_fill_middle.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    digest = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return op11_fill_middle.restore(filled).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return op12_nearest.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_whitening.whiten(_table(spark, sf_dir, "embeddings")).drop("deviation_exact")


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_counts": op3_token_counts_query,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_substring_dedup": op5_substring_dedup_query,
    "op6_language_id": op6_language_id,
    "op7_url_filters": op7_url_filters,
    "op8_line_dedup": op8_line_dedup_query,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_embedding_whitening": op13_embedding_whitening,
}
