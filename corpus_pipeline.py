"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparrowlog.llm import bpe, exact_dedup, language_id, mixing, simhash
from sparrowlog.llm.common import discard, fresh, release, scratch
from sparrowlog.llm.queries import MIX, vocabulary


#: Words of BPE's table; fewer than the operator's own number, since one driver runs all stages.
TABLE_WORDS = 1 << 16


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go, and a null lang is filled in."""
    model = language_id.learn(docs)
    (told,) = fresh(docs, "lang_pred__")
    found = language_id.tagged(docs, model, told)
    return found.filter(F.col(told) != language_id.UNDETERMINED).withColumn("lang", F.coalesce("lang", told)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one of the least doc_id."""
    return exact_dedup.drop_exact_copies(docs, keep="min")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least doc_id."""
    release(spark)
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample raked to the target weights of sources, languages and topics; a value with too few tokens for its target gives all it has."""
    return mixing.sample(docs, MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and the hashes that show the round trip."""
    return bpe.round_trip(docs, bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken")), table_size=TABLE_WORDS)


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing to target weights", mix), ("byte-level BPE", encode)]

#: Suffix automata, SimHash and merges can't be expressed in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next stage's documents, and goes once that is written."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        where = scratch(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
        if read:
            discard(spark, read)
        read = where
    return docs
