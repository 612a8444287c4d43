"""The corpus pipeline: five of the corpus operators in a row, each on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwright.llm import decontaminate, language_id, line_dedup, packing, simhash
from inkwright.llm._arrow import cut, table
from inkwright.llm.registry import tokenizer_path


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the fused evidence identifies; all others go.

    Null, empty and letterless texts go; repeated rows stay or go alike; other columns stay; an empty table stays empty.
    """
    return language_id.keep_identified(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of later occurrences of three-line windows; n_chars, if there, follows the text.

    Null and short texts stay; an empty table stays empty; repeated rows are treated alike; other columns stay.
    """
    out = line_dedup.dedup_lines(docs)
    removed = F.col(out.columns[-1])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(removed > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return out.select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the smallest doc_id, null last, one of repeated rows.

    Null and empty texts have one fingerprint and are one group; other columns stay; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget.

    Null and empty texts hold none and stay, as do repeated rows and other columns; an empty table stays empty.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and place.

    Null and empty texts are one end token; repeated rows are packed each; other columns are ignored; an empty table gives none.
    """
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_repeated_lines),
    ("simhash", without_near_copies),
    ("decontaminate", without_benchmark),
    ("packing", packed),
]

#: Fingerprints and bin completion are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, with a durable cut behind each but the last."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
