"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import containment, language, ngram_join, pii, piece_codec
from gridloom.llm.common import BATCH_BYTES, Scratch, table
from gridloom.llm.registry import PIECES

#: Share of the probability that a document's likeliest language needs.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts among them), or of no clear language, go. Repeated rows go or stay together; columns
    lang_pred and lang_score of docs would be replaced, others stay."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    found = language.identify(docs, language.train(docs, PIECES))
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SHARE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, of equal rows one; null and empty texts stay, and rows with a
    null id."""
    return ngram_join.ngram_jaccard_keep(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold three quarters of a benchmark item go; null and empty texts hold nothing and stay, as do all rows where the
    benchmark is empty."""
    return containment.without_items(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind; n_chars is counted anew. A null text stays null; every row stays."""
    return pii.masked(docs, pii.train(docs)).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of every document's pieces, their byte spans, and the digests of ids and decoded text. A null text is empty; repeated
    rows are all encoded."""
    coded = piece_codec.encode_pieces(docs, PIECES)
    return piece_codec.digests(coded, "piece_ids", "piece_starts", "piece_ends")


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("PII", personal_data), ("SentencePiece encoding and decoding", pieces)]

#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        last, docs = docs, scratch.save(stage(spark, docs, sf_dir), "stage")
        scratch.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
