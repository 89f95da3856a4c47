"""A corpus from raw documents: language, near duplicates, leaks, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from throughdoor.llm import decontaminate, langid, minhash, mixing, queries, tokenstore
from throughdoor.llm.stored import Shelf


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates.

    That is the row of the smallest doc_id; of several rows with that doc_id,
    the first by text. Rows without doc_id are kept.
    """
    found = minhash.near_duplicates(docs.select("doc_id", "text"))
    shelf = Shelf(spark, "dropped")
    # flags rather than rows travel: what goes is the smaller part
    dropped = shelf.put(found.where("NOT kept").select("doc_id").distinct(), "ids")
    kept = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = shelf.put(kept.where("n > 1").select("doc_id"), "repeated")
    left = docs.join(dropped, "doc_id", "left_anti")
    once = left.join(repeated, "doc_id", "left_anti")
    again = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min_by(F.struct(*docs.columns), F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("row"))
    return once.select(*docs.columns).union(again.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark", "item_id", "text"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents until every source has its share."""
    return mixing.repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids and returns what the files hold."""
    return tokenstore.stored(docs.select("doc_id", "text"), queries.vocabulary())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

# The tokenizer, the classifier and the signatures cannot be said in SQL; the
# tests hold every stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shelf = Shelf(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shelf.put(docs, name)
    return docs
