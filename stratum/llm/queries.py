"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every whole text, whether it is over 1024, and how much of it fits that budget."""
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 1024)


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every whole text, and whether they decode to it."""
    from .sentence_pieces import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from its own evidence and its site's rate."""
    from .quality import score_quality

    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "evidence", "host_rate", "path_rate", "score", "keep")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license templates in every whole text."""
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from labelled rows outside the held-out fold."""
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, as it is or with other numbers and names."""
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from rows outside the held-out fold."""
    from .language_id import predict_language

    return predict_language(table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products for every hundredth vector, among all others."""
    from .topk_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), lambda c: c % 100 == 0)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document: five-word shingles, similarity 0.8 or more."""
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text and in what is encoded in it."""
    from .secret_scan import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_sentence_pieces, op3_quality, op4_license_scan, op5_toxicity, op6_decontamination, op7_language_id, op8_top_k, op9_near_dedup, op10_secret_scan)}


def oracle_sql() -> dict[str, str]:
    from .license_scan import scan_licenses_sql

    from .topk_search import top_k_sql

    return {"op4_license_scan": scan_licenses_sql(), "op8_top_k": top_k_sql()}
