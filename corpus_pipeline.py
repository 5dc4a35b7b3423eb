"""A training corpus from `documents`: toxic texts go, then copies, then near copies; the rest is mixed and encoded.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns the columns of documents; the last returns the encoded corpus.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.llm import bpe, exact_dedup, minhash, mixing, toxicity
from pitlake.llm.common import cut, free_prefix, named

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold.

    Each row is judged by its own text; null and empty texts have the score of no
    evidence and stay. Repeated rows and null ids are kept as they are; columns may have any names.
    """
    mark = free_prefix(docs.columns, "_score")
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.score(docs, model, score_col=mark).where(F.col(mark) < TOXIC).select(*named(docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id; a null text equals an empty one.

    A row that is there several times, id and text, is left once (rows that differ
    elsewhere: any one of them). A null id loses to any other.
    """
    p = free_prefix(docs.columns, "_copy_")
    one = exact_dedup.exact_dedup(docs).where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    kept = cut(one.select(F.col("doc_id").alias(p + "id"), F.col("text_sha256").alias(p + "sha"), F.col("n").alias(p + "n")), "kept")
    marked = docs.withColumn(p + "text", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    same = marked["doc_id"].eqNullSafe(kept[p + "id"]) & (marked[p + "text"] == kept[p + "sha"])
    out = marked.join(kept.where(F.col(p + "n") == 1), same, "left_semi")
    repeated = kept.where(F.col(p + "n") > 1)
    if not repeated.isEmpty():
        out = out.unionByName(marked.join(repeated, same, "left_semi").dropDuplicates(["doc_id", p + "text"]))
    return out.select(*named(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicate texts, the one with the smallest id.

    Documents are told apart by id and text, so rows that repeat an id with other
    texts are judged each by its own. Texts without words and rows with a null id stay.
    """
    p = free_prefix(docs.columns, "_near_")
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(p + "id"), F.col("text_hash").alias(p + "hash"))
    marked = docs.withColumn(p + "text", minhash.text_hash(F.col("text")))
    return marked.join(kept, marked["doc_id"].eqNullSafe(kept[p + "id"]) & (marked[p + "text"] == kept[p + "hash"]), "left_semi").select(*named(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Seven tenths of the tokens by target weights, each document at most once.

    Null sources and languages count as empty names; texts without tokens go where
    their place in the order is. Rows that share an id stay or go together.
    """
    return mixing.mix(docs, mixing.domain_of(F.col("source")), mixing.WEIGHTS, share=0.7, epochs=1).select(*named(docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to.

    One row per row; a null text is empty and has no tokens. Other columns aren't read.
    """
    return bpe.with_codes(docs, public_tokenizers.path("word_bpe_49k.json"), full=True).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: a classifier and a sketch can't be written in SQL; tests/llm/test_pipeline.py has the brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs, name)
    return docs
