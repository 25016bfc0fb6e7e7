"""The queries of this subpackage, over whole tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, containment, html_text, language, ngram_join, pii, piece_codec, quality, reshard, token_orc
from .common import Scratch, table

#: The public tokenizers' files.
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
OLD_SHARDS, NEW_SHARDS = 6, 8


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digests(pii.find(docs, pii.train(docs)))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From OLD_SHARDS shards by a hash of the id to NEW_SHARDS of even bytes."""
    docs, scratch = table(spark, sf_dir, "documents").drop("shard"), Scratch(spark)
    rows, blocks = reshard.assign(docs, F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS)), NEW_SHARDS, scratch)
    path = scratch.path("shards")
    written = reshard.rewrite(rows, blocks, NEW_SHARDS, path)
    out = reshard.read_shards(spark, path, rows.schema)
    if set(blocks) - set(written):  # shards that stay as they are have no files here: their rows are the table's own
        out = out.unionByName(rows.where(~F.col("shard").isin(written)))
    return reshard.slots(out, scratch)


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("tokens")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path, WORDS, end=2)
    return token_orc.digests(spark, path)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(piece_codec.encode_pieces(table(spark, sf_dir, "documents"), PIECES))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality.score(docs.select("doc_id", "text"), quality.train(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (quality.bucket() % 3 == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = language.identify(docs.select("doc_id", "text"), language.train(docs, PIECES))
    return rows.select("doc_id", (language.bucket() % 4 == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


_ALL = (op1_ngram_jaccard, op2_pii, op3_html_text, op4_nearest, op5_decontamination, op6_reshard, op7_token_orc, op8_sentencepiece, op9_quality, op10_language)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {"op1_ngram_jaccard": ngram_join.SQL, "op5_decontamination": containment.SQL}
