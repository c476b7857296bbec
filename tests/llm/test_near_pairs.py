"""Copies that share many shingles meet once for the set of those, not once for each shingle."""

from sparrowlog.llm import simhash


def test_keys_of_the_same_nodes_are_one(spark, monkeypatch):
    """Before, three nodes under ten keys made thirty rows of pairs."""
    rows = [(key, node, node, 50, key - 10 + node % 2) for key in range(10, 20) for node in (1, 2, 3)] + [(30, 1, 1, 50, 3), (30, 2, 2, 50, 4), (31, 2, 2, 50, 5), (31, 9, 9, 50, 0)]
    df = spark.createDataFrame(rows, "key long, root long, node long, size int, at int")
    merged = simhash.merged_keys(df)
    assert merged.columns == df.columns and merged.count() == 3 + 2 + 2
    assert {(r.node, r["at"]) for r in merged.filter("key = 10").collect()} == {(1, 1), (2, 0), (3, 1)}
    assert sorted(map(tuple, simhash.rest_candidates(merged).collect())) == sorted(map(tuple, simhash.rest_candidates(df).collect())) == [(1, 2), (1, 3), (2, 3), (2, 9)]


def test_more_documents_are_counted_of_more(spark, monkeypatch):
    """A fixed number was, so what a few of very many documents share looked rare."""
    monkeypatch.setattr(simhash, "ORDER_DOCS", 20)
    docs = spark.createDataFrame([(i, f"common words of group {i // 8} stand here number {i}") for i in range(1600)], "doc_id long, text string")
    key, n = simhash.common_shingles(docs, 1600, 5, "doc_id", "text")
    assert n.sum() > 200 and len(key) == len(n)  # 20 documents have 100 shingles
