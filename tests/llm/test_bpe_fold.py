"""The fold's look-ups: rows of the rank map laid over one another, words sent as numbered bytes."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from sparrowlog.llm import bpe, common
from sparrowlog.llm.queries import vocabulary


def folded(spark, words, ranks):
    rank_map = bpe.RankMap(ranks)
    df = spark.createDataFrame(pa.table({"i": list(range(len(words))), "w": bpe.spelled(words, bpe.byte_pieces(ranks))}))
    rows = df.select("i", bpe._bound(rank_map.constants[:2], lambda *t: rank_map.fold_spelled(F.col("w"), *t)).cast("array<int>").alias("ids")).collect()
    return [r.ids for r in sorted(rows)]


def test_rows_of_the_rank_map_do_not_meet():
    pairs = {(a, b): a + b for a in random.Random(3).sample(range(1, 60_000), 400) for b in random.Random(a).sample(range(1, 60_000), a % 7 + 1)}
    begins, laid = bpe._displaced(pairs)
    assert all(laid[begins[a] + b] == a << 16 | u for (a, b), u in pairs.items())
    assert sum(x != 0 for x in laid) == len(pairs) and len(begins) == 1 << 16 and max(begins) + (1 << 16) <= len(laid)


def test_spelled_words_fold_as_they_merge(spark):
    """Before, words went to Spark as strings and were split there, and a look-up was two hashed reads."""
    ranks, r = bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken")), random.Random(5)
    words = ["a", "aaaaaaa", " " * 50, "é" * 100, "x" * 200, "ababababa", "🙂🙂", " thingataninthth"] + ["".join(r.choices("abehinrst é漢", k=r.randint(1, 60))) for _ in range(200)]
    assert folded(spark, words, ranks) == [bpe.merge(w.encode(), ranks) for w in words]


def test_ties_and_falling_ranks_go_first_from_the_left(spark):
    """Vocabularies that no training gives: one union of several splits, unions that come before their parts."""
    for seed in range(3):
        r = random.Random(seed)
        tokens = list(dict.fromkeys([bytes([b]) for b in range(256)] + ["".join(r.choices("ab", k=r.randint(2, 5))).encode() for _ in range(40)]))
        ids = r.sample(range(len(tokens)), len(tokens))
        ranks = dict(zip(tokens, ids))
        words = ["".join(r.choices("ab", k=r.randint(1, 14))) for _ in range(150)]
        assert folded(spark, words, ranks) == [bpe.heap_merge(w.encode(), ranks) for w in words]


def test_no_words_are_spelled_as_none():
    assert bpe.spelled([], bpe.byte_pieces({bytes([b]): b for b in range(256)})).to_pylist() == []


def test_executors_give_memory_back_before_words_are_folded(spark, sf, monkeypatch):
    """Before, the heap that earlier stages of the pipeline had grown stayed beside four Python workers an executor."""
    asked = []
    monkeypatch.setattr(bpe, "release_executors", lambda s: (asked.append(s), common.release_executors(s)))
    bpe.encode(spark.read.parquet(f"{sf}/documents.parquet").limit(5), bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken")))
    assert asked == [spark]


def test_texts_are_joined_in_small_batches(spark):
    """Before, a second function joined 2,000 documents at once; what it gives is the same wherever batches are cut."""
    ranks = bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    texts = [f"w{i} word{i % 7} thing{i * 31}" for i in range(3 * bpe.BATCH + 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {i: [r for w in bpe.regex.findall(bpe._PYTHON_PATTERN, t) for r in bpe.merge(w.encode(), ranks)] for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in bpe.encode(docs, ranks).collect()} == want


def test_the_table_has_the_size_asked_for(spark, sf):
    """The pipeline's driver holds a smaller table; before, all callers had the same."""
    docs, ranks = spark.read.parquet(f"{sf}/documents.parquet"), bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    assert len(bpe.common_words(docs, ranks, size=20)) == 20
