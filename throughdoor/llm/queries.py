"""Registered queries of the corpus operators, with production parameters."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from throughdoor.llm import (
    centroids, decontaminate, html, langid, licenses, minhash, mixing, negatives, neighbours, pii, preferences, tokenstore, toxicity)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents", "doc_id", "text"),
                           table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.stored(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"),
                                      table(spark, sf_dir, "benchmark", "item_id", "text"))


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return preferences.formatted(*preferences.reply_pairs(turns))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), label=moved)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_language, op3_neighbours, op4_mixing, op5_html, op6_token_ids, op7_decontamination, op8_preferences, op9_minhash,
    op10_pii, op11_licenses, op12_hard_negatives, op13_centroids)}
