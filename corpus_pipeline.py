"""A corpus pipeline of five stages: toxicity, line dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes what the one before kept, read again from Parquet, and returns the columns of ``documents``; the last
returns each document's ids. ``n_chars`` follows the text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from veilmark.scratch import checkpoint_dir

#: The network is trained in numpy, so no SQL gives run()'s rows; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a network fitted on the labelled rows; rows without text or id stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, score_col="_score").where("_score < 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten documents or more have."""
    done = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least id. Rows that repeat an id, or have none, stay or go together."""
    groups = ngram_join.similar_groups(docs, words_in_gram=5, percent=75)
    heads = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_head")).distinct()
    return docs.join(heads.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_head")), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(mixing.mix(docs, weights=(1, 2, 3), most=3), docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, ids_sha256, decoded_sha256): little-endian 32-bit ids, and the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.round_trip(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{root}/{i}-{name}")
        docs = spark.read.parquet(f"{root}/{i}-{name}")
    return docs
