"""A corpus pipeline over ``documents``: language, exact copies, near copies, source mix, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from dotspark.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from dotspark.llm.queries import tokenizer_path
from dotspark.llm.scratch import keyed, materialise

#: Documents whose best language's share is ahead of the next best by no more than this are rejected.
MIN_LEAD = 0.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no text, no letter, or no language ahead of the others.

    The filters are learned from the rows that are not held out. Rows with a null id are kept or rejected
    like any other, and so are rows that repeat an id: each by its own text.
    """
    filters = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    docs, key = keyed(docs, "language-rows")
    found = language_id.predict(docs, filters, id_col=key)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("lead") > MIN_LEAD)).select(key)
    return docs.join(kept, key, "left_semi").drop(key)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, shingle=5, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: a document comes as often as its whole passes, once more below the threshold.

    The document that straddles a source's budget counts as taken when half of it or more is. Rows that repeat an
    id, or have none, are taken each by its own words.
    """
    docs, key = keyed(docs, "mix-rows")
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    copy = f"copy_{uuid.uuid4().hex}"  # no column of docs has this name
    taken = mixing.mix(docs, also=(key,)).select(key, F.explode(F.array_repeat(F.lit(0), times)).alias(copy))
    return docs.join(taken, key).drop(key, copy)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, checked by decoding: doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids themselves."""
    coded = bpe.round_trip(docs, tokenizer_path())
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mix", mixed), ("bpe", tokens)]

#: SQL has no byte-level BPE and no near-duplicate components over learned decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
