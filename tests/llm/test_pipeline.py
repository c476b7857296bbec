"""The pipeline's stages, each on what the one before kept."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparrowlog.llm import bpe, mixing, queries


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, "x", 0), (9002, "12 + 3 = !!", "en", "x", 11), (9003, "", "en", "x", 0)], docs.schema.simpleString()[7:-1].replace(":", " "))
    docs = docs.unionByName(extra).withColumn("lang_pred__", F.lit("clash"))
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(out := f"{tmp_path}/{k}")
        after = spark.read.parquet(out)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns, name
            assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in docs.collect()}
            docs = after
        kept.append(after.count())
    assert kept[0] == 200 and kept[1] == 189 and kept[2] <= 189 and 0 < kept[3] < kept[2] and kept[4] == kept[3]
    want = bpe.round_trip(docs, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))).collect()
    assert sorted(after.collect()) == sorted(want)


def test_exact_stage_keeps_the_least_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    least = {r.m for r in docs.groupBy("text").agg(F.min("doc_id").alias("m")).collect()}
    assert {r.doc_id for r in corpus_pipeline.exact(spark, docs, sf).collect()} == least


def test_mixing_stage_follows_its_plan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.mix(spark, docs, sf).collect()} == {r.doc_id for r in mixing.plan(docs, queries.MIX).filter("selected").collect()}


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in ("op6_warc_fixity",)])
def test_queries_give_a_row_a_document(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() == 200


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
