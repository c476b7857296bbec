"""The k best of BM25 by blocks, against the rows of all scores."""

import pytest
from pyspark.sql import functions as F

from sparrowlog.operators import retrieval


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_best_by_blocks_are_the_best_of_all(spark, k):
    texts = [("a1 b1 c1", 1), ("a1 a1 d1", 2), ("b1 c1", 3), ("zz yy", 4), ("a1 b1 c1", 5), ("", 6), (None, 7)] + [(f"a1 w{i % 5}x b1", 10 + i) for i in range(40)]
    docs = spark.createDataFrame([(str(i), t) for t, i in texts], "id string, text string")
    asked = spark.createDataFrame([("a1 b1 a1",), ("a1 b1 a1",), ("w3x",), ("none here",), ("",), (None,)], "query string")
    index = retrieval.postings(docs, "id", F.col("text"))
    got = retrieval.bm25_top(asked, index, docs.count(), k, block_docs=9)
    assert "FlatMapCoGroups" in got._jdf.queryExecution().executedPlan().toString()
    want = retrieval.top_k(retrieval.bm25_scores(asked, index), k, "query")
    row = lambda r: (r["query"], r.doc_id, round(r.score, 9), r["rank"])
    assert sorted(map(row, got.collect())) == sorted(map(row, want.collect()))
