"""Lexical (BM25) and dense retrieval.

BM25 keeps postings (term, doc_id, weight): the whole score of a term in a
document is in the posting, so scoring is one equi-join and a sum.  Equal
queries are scored once.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import dot, unit
from ..functions.stemming import stem
from ..shared import stored

K1, B = 1.5, 0.75
#: Added to every weight, so that weights of 0 are equal and don't count beside others.
_LEAST_WEIGHT = 1e-30
#: Retrieved before the date filter, and kept after it.
OVERFETCH, KEEP = 600, 200


def document_text(articles: DataFrame, fields: tuple[str, ...]) -> Column:
    """The fields joined by spaces; a null field still adds its space, an all-null field isn't used."""
    used = [f for f in fields if f in articles.columns]
    filled = articles.agg(*(F.count(f).alias(f) for f in used)).first() if used else {}
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in used if filled[f]]
    return F.concat_ws(" ", *parts) if parts else F.lit("")


def terms(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Lower-cased words of two or more letters, digits, marks or underscores, in order, with repeats."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_\p{M}]{2,})"), 1)
    return F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found


def stemmed(exploded: DataFrame, language: str, term: str = "term") -> DataFrame:
    """Terms replaced by their stems; the stemmer runs once for each distinct term."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(lambda w: stem(w, language))

    vocabulary = exploded.select(term).distinct().withColumn("__stem", stems(term))
    return exploded.join(vocabulary, term).drop(term).withColumnRenamed("__stem", term)


def postings(docs: DataFrame, doc_id: str, text: Column, language: str | None = None, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(term, doc_id, tf, df, dl, weight); documents without terms have none, but count for N and the mean length."""
    each = docs.select(F.col(doc_id).alias("doc_id"), F.explode(terms(text, stopwords)).alias("term"))
    each = stemmed(each, language) if language else each
    tf = each.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    dl = tf.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    size = docs.agg(F.count("*").alias("n")).crossJoin(dl.agg(F.sum("dl").alias("total")))  # one row each
    joined = tf.join(df, "term").join(dl, "doc_id").crossJoin(F.broadcast(size))
    return joined.select("term", "doc_id", "tf", "df", "dl", _weight().alias("weight"))


def _weight() -> Column:
    """A term's share of a document's score, of n, total, df, tf and dl."""
    n, d, f = (F.col(c).cast("double") for c in ("n", "df", "tf"))
    mean = F.col("total") / n
    idf = F.log(F.lit(1.0) + (n - d + F.lit(0.5)) / (d + F.lit(0.5)))
    return idf * f / (f + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("dl") / mean))


def unique_ids(docs: DataFrame, doc_id: str) -> bool:
    return docs.groupBy(doc_id).count().filter("count > 1").limit(1).count() == 0


def term_counts(docs: DataFrame, text: Column, asked: DataFrame) -> DataFrame:
    """(term, df, n) of the terms ``asked`` (term), and one row of the term "": df documents there are, n terms in all.

    Terms are counted where documents stand, so no row for each term and
    document is sent around.  A document is a row here.
    """
    one = lambda t, n: F.struct(t.alias("term"), n.cast("long").alias("n"))
    words = docs.select(terms(text).alias("t")).select(F.concat(F.array(one(F.lit(""), F.size("t"))), F.transform(F.array_distinct("t"), lambda t: one(t, F.lit(1)))).alias("x"))
    wanted = asked.select("term").unionByName(asked.sparkSession.createDataFrame([("",)], "term string")).distinct()
    return words.select(F.inline("x")).join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n"))


def own_postings(docs: DataFrame, doc_id: str, text: Column, asked: DataFrame, own: DataFrame) -> DataFrame:
    """``postings`` of the documents ``own`` (doc_id) and the terms ``asked`` (term), few of both, with the weights they have among all.

    The documents' ids must be unique.
    """
    counts = stored(term_counts(docs, text, asked), "terms")
    size = counts.filter("term = ''").select(F.col("df").alias("n"), F.col("n").alias("total"))
    mine = docs.select(F.col(doc_id).alias("doc_id"), terms(text).alias("t")).join(F.broadcast(own), "doc_id", "left_semi")
    tf = mine.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    joined = tf.join(counts.filter("term <> ''").select("term", "df"), "term").crossJoin(F.broadcast(size))
    return joined.select("term", "doc_id", "tf", "df", "dl", _weight().alias("weight"))


def query_terms(queries: DataFrame, query: str = "query", language: str | None = None, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(query, term, qtf) of each distinct query."""
    each = queries.select(query).distinct().select(query, F.explode(terms(F.col(query), stopwords)).alias("term"))
    each = stemmed(each, language) if language else each
    return each.groupBy(query, "term").agg(F.count("*").alias("qtf"))


def bm25_scores(queries: DataFrame, index: DataFrame, query: str = "query", language: str | None = None, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(query, doc_id, score) for each distinct query and each document that shares a term with it."""
    q = query_terms(queries, query, language, stopwords)
    return q.join(index, "term").groupBy(query, "doc_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("score"))


def bm25_top(queries: DataFrame, index: DataFrame, docs: int, k: int, query: str = "query", doc_kind: str = "string", language: str | None = None, stopwords: tuple[str, ...] = (), block_docs: int = 16_000) -> DataFrame:
    """(query, doc_id, score, rank): the k best of ``bm25_scores`` for each distinct query, without a row for each query and document.

    Documents are cut into blocks of about ``block_docs`` of the ``docs`` that
    there are; a block's postings are summed for one query after another, and
    only each query's k best of a block go on.
    """
    import numpy as np

    q = query_terms(queries, query, language, stopwords)
    blocks = max(queries.sparkSession.sparkContext.defaultParallelism, -(-docs // block_docs))
    mine = index.select("term", "doc_id", "weight").join(q.select("term").distinct(), "term", "left_semi").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    asked = q.select(F.col(query).alias("query"), "term", "qtf").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def f(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "doc_id": [], "score": []}, dtype="object")
        term, terms_ = pd.factorize(right.term)
        doc, docs_ = pd.factorize(right.doc_id, sort=True)
        order = np.argsort(term, kind="stable")
        ends, doc, weight = np.searchsorted(term[order], np.arange(len(terms_) + 1)), doc[order], right.weight.to_numpy()[order]
        code, names = pd.factorize(left["query"])
        at, by = pd.Index(terms_).get_indexer(left.term), np.argsort(code, kind="stable")
        starts, qtf = np.searchsorted(code[by], np.arange(len(names) + 1)), left.qtf.to_numpy()
        who, what, score = [], [], []
        for i in range(len(names)):
            s = np.zeros(len(docs_))
            for row in by[starts[i] : starts[i + 1]]:
                if at[row] >= 0:
                    own = slice(ends[at[row]], ends[at[row] + 1])
                    s[doc[own]] += qtf[row] * weight[own]
            best = np.flatnonzero(s)
            worst = -np.round(s[best], 9)
            if len(best) > k:
                keep = worst <= np.partition(worst, k - 1)[k - 1]
                best, worst = best[keep], worst[keep]
            best = best[np.argsort(worst, kind="stable")[:k]]
            who.append(np.full(len(best), i))
            what.append(best)
            score.append(s[best])
        who, what = np.concatenate(who), np.concatenate(what)
        return pd.DataFrame({"query": names.to_numpy()[who], "doc_id": docs_.to_numpy()[what] if hasattr(docs_, "to_numpy") else docs_[what], "score": np.concatenate(score)})

    found = asked.groupBy("block").cogroup(mine.groupBy("block")).applyInPandas(f, f"query string, doc_id {doc_kind}, score double")
    return top_k(found, k, "query")


def pair_bm25(pairs: DataFrame, queries: DataFrame, index: DataFrame, by: str = "imp", query: str = "query", item: str = "item", language: str | None = None, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """``pairs`` (by, item, ...) with bm25: the score of the pair's own document for its list's query (by, query); 0 without a shared term.

    Only the pairs' postings are read, so the work follows the pairs and not
    the documents that share a term with a query.
    """
    each = queries.select(by, F.explode(terms(F.col(query), stopwords)).alias("term"))
    each = stemmed(each, language) if language else each
    asked = each.groupBy(by, "term").agg(F.count("*").alias("qtf"))
    shown = pairs.select(by, F.col(item).alias("doc_id")).distinct()
    mine = index.select("doc_id", "term", "weight").join(shown.select("doc_id").distinct(), "doc_id", "left_semi")
    scores = shown.join(asked, by).join(mine, ["doc_id", "term"]).groupBy(by, "doc_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("bm25"))
    return pairs.join(scores.withColumnRenamed("doc_id", item), [by, item], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def top_k(scores: DataFrame, k: int, *by: str, item: str = "doc_id", score: str = "score") -> DataFrame:
    """Rows of the k best scores of each group with their rank; ties by item."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round(score, 9)), item))
    return scores.withColumn("rank", r).filter(F.col("rank") <= k)


def overfetch(ranked: DataFrame, published: DataFrame, *by: str, at: str = "ts", item: str = "item", keep: int = KEEP) -> DataFrame:
    """Of lists cut at OVERFETCH, the first ``keep`` that were published by then, ranked anew.

    May leave fewer than ``keep``: what lies beyond the cut isn't fetched again.
    Items without a publication time count as published.
    """
    known = ranked.join(published, item, "left").filter(F.col("published_time").isNull() | (F.col("published_time") <= F.col(at)))
    r = F.row_number().over(Window.partitionBy(*by).orderBy("rank"))
    return known.withColumn("rank", r).filter(F.col("rank") <= keep)


def positive(weight: Column | None) -> Column:
    """A weight of a history row as it counts: 1 for none given, below 0 as 0, and a trace for 0."""
    return F.greatest(weight, F.lit(0.0)) + F.lit(_LEAST_WEIGHT) if weight is not None else F.lit(1.0)


def user_vectors(history: DataFrame, vectors: DataFrame, weight: Column | None = None, *by: str) -> DataFrame:
    """(by, u): unit mean of the vectors of history rows, weighted if asked; items without vector are skipped.

    Weights below 0 count as 0; weights that are all 0 count as equal.  One
    aggregate over whole vectors, with map-side combining.
    """
    by = by or ("imp",)
    rows = history.withColumn("w", positive(weight)).join(vectors, "item").select(*by, "w", array_to_vector("v").alias("x"))
    mean = rows.groupBy(*by).agg(vector_to_array(Summarizer.mean(F.col("x"), F.col("w"))).alias("m"))
    return mean.select(*by, unit(F.col("m")).alias("u"))


def pair_cosine(pairs: DataFrame, users: DataFrame, vectors: DataFrame, name: str = "emb", by: str = "imp") -> DataFrame:
    """``pairs`` with the cosine of user and item; 0 if either has no vector."""
    return pairs.join(users, by, "left").join(vectors, "item", "left").withColumn(name, F.coalesce(dot(F.col("u"), F.col("v")), F.lit(0.0))).drop("u", "v")


def exact_knn(queries: DataFrame, corpus: DataFrame, k: int, query: str = "query", item: str = "item", vector: str = "v", block_rows: int = 20_000) -> DataFrame:
    """(query, item, score, rank): the k greatest inner products, ties by item.

    All of the query set against all of the corpus is what exact search is.
    Both are cut into blocks of about ``block_rows`` vectors, as many as their
    sizes ask for, so that a pair of blocks fits in a task; each pair meets as
    matrices, and only each query's k best of a block go on.
    """
    import numpy as np

    least = max(1, queries.sparkSession.sparkContext.defaultParallelism // 2)
    blocks = max(2, -(-corpus.count() // block_rows))
    query_blocks = max(-(-least // blocks) * 2, -(-queries.count() // block_rows))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = corpus.select(part(item, blocks).alias("block"), F.col(item).alias("item"), F.col(vector).alias("v")).withColumn("part", each(query_blocks))
    asked = queries.select(part(query, query_blocks).alias("part"), F.col(query).alias("query"), F.col(vector).alias("q")).withColumn("block", each(blocks))

    def f(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "item": [], "score": []}, dtype="object")
        right = right.sort_values("item", ignore_index=True)
        m, out = np.stack(right.v.to_numpy()), []
        for at in range(0, len(left), 1024):
            part = left.iloc[at : at + 1024]
            s = np.stack(part.q.to_numpy()) @ m.T
            best = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query": np.repeat(part["query"].to_numpy(), best.shape[1]), "item": right.item.to_numpy()[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()}))
        return pd.concat(out)

    kind = dict(queries.dtypes)[query], dict(corpus.dtypes)[item]
    found = asked.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInPandas(f, f"query {kind[0]}, item {kind[1]}, score double")
    return top_k(found, k, "query", item="item")


def fields_variant(articles: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``articles`` with the text of these fields, to compare retrieval variants."""
    return articles.withColumn("text", document_text(articles, fields))


def union_pools(*pools: DataFrame) -> DataFrame:
    """The candidates that any of the pools retrieved, once."""
    return reduce(DataFrame.unionByName, (p.select("query", "item") for p in pools)).distinct()


