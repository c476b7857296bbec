"""Rare words are folded by Spark, each once a task, with the ids that merging gives."""

import numpy as np

from sparrowlog.llm import bpe
from sparrowlog.llm.queries import vocabulary


def test_rare_words_are_folded_by_spark(spark, sf, monkeypatch):
    """Before, words outside the table were merged in Python."""
    ranks = bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + [None, "", "x" * 300 + " ok", "  \n\t ", "naïve 漢字 🙂 don't"]
    want = {i: [r for w in bpe.regex.findall(bpe._PYTHON_PATTERN, t or "") for r in bpe.heap_merge(w.encode(), ranks)] for i, t in enumerate(texts)}

    heap, long = bpe.heap_merge, bpe.LONG_WORD

    def short(word, ranks):
        assert len(word) > long
        return heap(word, ranks)

    monkeypatch.setattr(bpe, "merge", short)
    monkeypatch.setattr(bpe, "COMMON_WORDS", 30)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 200)
    monkeypatch.setattr(bpe, "BATCH", 7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    encoded = bpe.encode(docs, ranks)
    assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.ids for r in encoded.collect()} == want


def test_entries_become_ids():
    joiner = bpe.TailJoiner()
    joiner.add(np.array([7, 8, 9], np.int32), np.array([2, 1]), False)
    joiner.add(np.array([4], np.int32), np.array([1]), False)
    ids, ends = joiner.join(np.array([-1, 5, -3, -2], np.int32), np.array([0, 2, 2, 4]))
    assert ids.tolist() == [7, 8, 5, 4, 9] and ends.tolist() == [0, 3, 3, 5]
    joiner.add(np.array([1], np.int32), np.array([1]), True)
    assert joiner.join(np.array([-1], np.int32), np.array([0, 1]))[0].tolist() == [1]
