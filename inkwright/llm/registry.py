"""The corpus operators' queries, each over its whole table, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import avi, backoff, decontaminate, language_id, line_dedup, packing, quality, secrets, simhash, token_counts
from ._arrow import table


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file of that name lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_avi_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_digests(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_avi_shots, op2_decontaminate, op3_token_counts, op4_stupid_backoff, op5_simhash, op6_language_id, op7_secret_scan, op8_best_fit_packing, op9_quality, op10_line_dedup)}

ORACLES = {
    "op4_stupid_backoff": backoff.SQL,
    "op10_line_dedup": line_dedup.ORACLE.format(docs="documents") + "SELECT d.doc_id, k.text, d.lang, d.source, d.n_chars, k.removed_lines FROM documents d JOIN kept k ON k.doc_id = d.doc_id",
}
