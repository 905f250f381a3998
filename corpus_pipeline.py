"""From raw documents to training tokens: reject, deduplicate, thin out near copies, mix, encode.

Each stage works on all rows that the one before kept.  Between stages the documents are written as
Parquet to the folder that all executors share and read again, so a lost executor costs no stage.
Rows that the operators can't judge follow their rules: a null text is rejected by the first stage,
so none reaches the others; empty texts are copies of each other, have no n-grams to be compared by
and no tokens.  Rows that repeat text and doc_id become one in the second stage.  Columns come out of
every stage as they went in, whatever they are called; the last adds tokens and n_tokens, in place of
columns of those names.  An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trellium.llm import exact_dedup, mixing, ngram_join, resampling, shared, token_codec


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards the documents labelled good; what it rejects goes."""
    return resampling.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group joined by n-gram Jaccard similarity stays."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weight; a document comes once for each epoch that takes it."""
    return mixing.rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids beside the documents."""
    return token_codec.encode(docs)


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]
#: Resampling, components of near copies and BPE can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared.new_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
