"""The registered queries over the engine's operators; ``oracle`` has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import Dataset
from ..functions import columns as C
from ..functions.windows import average_rank, ordinal_rank, over_max, scaled_rank
from ..operators import beyond, export, features, fusion, held, metrics, ranker, retrieval, splits, stats
from ..operators.causal import causal_counts, latest_before
from ..shared import scratch, spread, stored
from ..streaming.exposure import hourly_exposures, run_to_end
from . import universe as U

L1 = Dataset("L1")
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
Q = Callable[[SparkSession, str], DataFrame]


def query(f: Q) -> Q:
    REGISTRY[f.__name__] = f
    return f


def _log(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ev = U.events(spark, sf)
    return ev, U.candidates(ev)


def _joined(items):
    return F.array_join(items, ",")


# ------------------------------------------------------------ model and splits


@query
def impressions_normalised(spark: SparkSession, sf: str) -> DataFrame:
    i = U.impressions(U.events(spark, sf))
    return i.select("impression_id", "user_id", "timestamp", _joined("candidates").alias("candidates"), _joined("clicked").alias("clicked"), F.size("history").cast("long").alias("hist_len"))


@query
def impressions_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    i = U.candidates(U.events(spark, sf)).select("imp", "ts").distinct().withColumn("split", splits.split_of(F.col("ts"), L1))
    return i.groupBy("split").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))


@query
def articles_dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of two sources, the second of which has ids of the first."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("article_id"), F.col("text").alias("title"))
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select((F.col("item_id") + 190).alias("article_id"), F.col("text").alias("title"))
    return splits.keep_first([d, b], "article_id")


@query
def packed_pairs_parse(spark: SparkSession, sf: str) -> DataFrame:
    c = U.order_log(spark, sf).groupBy("imp").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws("-", "item", F.col("label").cast("string")).alias("p")))).alias("c"))
    shown, clicked = C.packed_pairs(F.array_join(F.transform("c", lambda x: x.p), " "))
    return c.select("imp", _joined(shown).alias("candidates"), _joined(clicked).alias("clicked"), F.size(shown).cast("long").alias("n"))


@query
def json_entities_parse(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    js = lambda *cols: F.concat(F.lit("["), F.concat_ws(",", *(F.concat(F.lit('{"Label":"'), F.col(c), F.lit('","Confidence":1.0}')) for c in cols)), F.lit("]"))
    title = F.when(F.col("doc_id") % 5 != 0, js("source", "lang"))
    ents = C.union_keep_order(C.entity_labels(title), C.entity_labels(js("lang", "source")))
    return d.select("doc_id", _joined(ents).alias("entities"), F.size(ents).cast("long").alias("n"))


@query
def history_tokens_nonempty(spark: SparkSession, sf: str) -> DataFrame:
    i = U.impressions(U.events(spark, sf))
    packed = F.when(F.size("history") > 0, F.array_join("history", " ")).otherwise(F.when(F.col("impression_id") % 2 == 0, F.lit("")))
    return i.select("impression_id", F.size(C.tokens(packed)).cast("long").alias("n"))


@query
def clock_text_parse(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", C.clock_12h(F.date_format("ts", "M/d/yyyy h:mm:ss a")).alias("ts"))


@query
def recency_seconds(spark: SparkSession, sf: str) -> DataFrame:
    return splits.recency_seconds(U.impressions(U.events(spark, sf))).select("impression_id", "recency_seconds")


@query
def latest_click_before(spark: SparkSession, sf: str) -> DataFrame:
    ev, _ = _log(spark, sf)
    imps = ev.groupBy("imp", "user_id").agg(F.min("us").alias("us"))
    return latest_before(imps, ev.filter("click"), "user_id").select("imp", (F.col("us") - F.col("last_us")).alias("since_us"))


@query
def history_last_n(spark: SparkSession, sf: str) -> DataFrame:
    i = U.impressions(U.events(spark, sf))
    return i.select("impression_id", _joined(C.last_n(F.col("history"), 3)).alias("last"), _joined(F.slice("candidates", 1, 2)).alias("head"))


# -------------------------------------------------------------- causal counts


def _counts(spark: SparkSession, sf: str, windows: dict, clicks: bool) -> DataFrame:
    ev, c = _log(spark, sf)
    return causal_counts(c, ev.filter("click") if clicks else ev, "item", windows)


@query
def pop_causal_unbounded(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf, {"n": None}, True).select("imp", "item", "n")


@query
def pop_causal_6h(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf, {"n": 6.0}, True).select("imp", "item", "n")


@query
def exp_causal_24h(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf, {"n": 24.0}, False).select("imp", "item", "n")


@query
def pop_causal_l2(spark: SparkSession, sf: str) -> DataFrame:
    o = U.order_log(spark, sf)
    counted = causal_counts(o, o.filter("label = 1"), "item", {"n": 24.0 * 90, "past": None}, bucket=24 * 3_600_000_000 * 30)
    return counted.groupBy("item").agg(F.sum("n").alias("n"), F.sum("past").alias("past"))


@query
def exposure_features(spark: SparkSession, sf: str) -> DataFrame:
    ev, c = _log(spark, sf)
    p = features.popularity(c, ev, 6.0, "exp")
    return p.select("imp", "item", "exp_causal", "exp_24h", *(F.round(x, 6).alias(x) for x in ("exp_velocity", "exp_rank", "exp_rel_max")))


@query
def pop_rank(spark: SparkSession, sf: str) -> DataFrame:
    c = _counts(spark, sf, {"n": None}, True)
    return c.select("imp", "item", F.round(scaled_rank(F.col("n"), "imp"), 6).alias("pop_rank"), F.round(over_max(F.col("n"), "imp"), 6).alias("pop_rel_max"), average_rank(F.col("n"), "imp").alias("average"), ordinal_rank(F.col("n"), F.col("pos"), "imp").cast("long").alias("ordinal"))


# ------------------------------------------------------------------- features


def _history(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    i = U.impressions(U.events(spark, sf))
    return i, U.history(i)


@query
def age_recency(spark: SparkSession, sf: str) -> DataFrame:
    _, c = _log(spark, sf)
    return features.freshness(c, U.articles(spark, sf)).select("imp", "item", F.round("age_hours", 6).alias("age_hours"), F.round("recency", 6).alias("recency"))


@query
def cat_match(spark: SparkSession, sf: str) -> DataFrame:
    _, c = _log(spark, sf)
    return features.category_match(c, _history(spark, sf)[1], U.articles(spark, sf)).select("imp", "item", F.round("cat_match", 6).alias("cat_match"))


@query
def ent_overlap(spark: SparkSession, sf: str) -> DataFrame:
    _, c = _log(spark, sf)
    return features.entity_overlap(c, _history(spark, sf)[1], U.articles(spark, sf)).select("imp", "item", F.round("ent_overlap", 6).alias("ent_overlap"))


@query
def user_engagement(spark: SparkSession, sf: str) -> DataFrame:
    return features.engagement(_history(spark, sf)[1]).select("imp", F.round("user_read", 6).alias("user_read"), F.round("user_scroll", 6).alias("user_scroll"))


@query
def n_cands_hist_len(spark: SparkSession, sf: str) -> DataFrame:
    i, _ = _history(spark, sf)
    return i.select("impression_id", F.size("candidates").cast("long").alias("n_cands"), F.size("history").cast("long").alias("hist_len"), F.size("clicked").cast("long").alias("n_clicked"))


@query
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """All features.  Lists are scored where they stand while all tasks can hold what they meet; else by joins, from files that several features read."""
    ev, c = _log(spark, sf)
    a, v = U.articles(spark, sf), U.vectors(spark, sf)
    every, ids = held.held_vectors(v, met=ev), held.met_ids(ev, held.HELD_ITEMS)
    known = None
    if every and ids:
        met = a.select(F.col("article_id").alias("item"), "title", "category", "entities", "published_time").join(F.broadcast(ids), "item", "left_semi")
        known = held.held_articles(met := stored(met, "met"), lambda titles: _title_scores(titles, a, True))
    if known:
        dim = F.broadcast(met.select(F.col("item").alias("article_id"), "published_time"))
        t = features.listed_features(U.impressions(ev), ev.select("item", "us", "click"), dim, L1, every, known)
    else:
        c, h = stored(c, "candidates"), stored(_history(spark, sf)[1], "history")
        scores = stored(_bm25(spark, sf, base=(_emb(spark, sf, base=(c, h)), h)).select("imp", "item", "emb", "bm25"), "scores")
        t = features.feature_table(c, scores, stored(ev, "events"), h, a, v, L1)
    return t.select("imp", "item", F.col("label").cast("long").alias("label"), *(F.round(F.col(f).cast("double"), 4).alias(f) for f in L1.features()))


@query
def leaky_totals(spark: SparkSession, sf: str) -> DataFrame:
    _, c = _log(spark, sf)
    a = U.articles(spark, sf).withColumn("total_inviews", F.when(F.col("article_id").cast("int") % 3 != 0, F.col("total_inviews")))
    return features.leaky_features(c, a).select("imp", "item", F.round("log_total_inviews", 6).alias("log_total_inviews"))


@query
def block_history(spark: SparkSession, sf: str) -> DataFrame:
    """Engagement of each impression's user from the block its split may read: the early clicks, or for test its own."""
    ev, c = _log(spark, sf)
    imps = c.select("imp", "user_id", "ts").distinct().withColumn("split", splits.split_of(F.col("ts"), L1))
    block = F.when(splits.split_of(F.col("ts"), L1) == "test", "test").otherwise("early")
    records = ev.filter("click").withColumn("block", block).groupBy("user_id", "block").agg(F.count("*").alias("clicks"))
    return features.block_history(imps, records).select("imp", "split", "block", "clicks")


@query
def constant_check(spark: SparkSession, sf: str) -> DataFrame:
    """Which features have one value or none; two are made so."""
    ev, c = _log(spark, sf)
    p = features.popularity(c, ev, 6.0, "exp").withColumn("bm25", F.lit(0.0)).withColumn("emb", F.lit(None).cast("double"))
    return features.constant_flags(p, ["bm25", "emb", "exp_causal", "exp_24h", "exp_rank"])


# ----------------------------------------------------------- vectors and BM25


@query
def user_vector_mean(spark: SparkSession, sf: str) -> DataFrame:
    h = _history(spark, sf)[1].filter("h > hist_len - 10")
    u = retrieval.user_vectors(h, U.vectors(spark, sf), None, "imp")
    return u.select("imp", *(F.round(F.get("u", F.lit(i)), 6).alias(f"u{i}") for i in (0, 1, 63)), F.round(C.norm(F.col("u")), 5).alias("norm"))


@query
def user_vector_weighted(spark: SparkSession, sf: str) -> DataFrame:
    w = F.log1p(F.greatest(C.number_or_zero(F.col("read_time")), F.lit(0.0)))
    u = retrieval.user_vectors(_history(spark, sf)[1], U.vectors(spark, sf), w, "imp")
    return u.select("imp", *(F.round(F.get("u", F.lit(i)), 6).alias(f"u{i}") for i in (0, 1, 63)))


def _emb(spark: SparkSession, sf: str, last: int = 10, base: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    c, h = base or (_log(spark, sf)[1], _history(spark, sf)[1])
    h = h.filter(F.col("h") > F.col("hist_len") - last)
    v = U.vectors(spark, sf)
    return retrieval.pair_cosine(c, retrieval.user_vectors(h, v, None, "imp"), v)


@query
def cosine_pool(spark: SparkSession, sf: str) -> DataFrame:
    return _emb(spark, sf).select("imp", "item", F.round("emb", 6).alias("emb"))


@query
def engage_sim(spark: SparkSession, sf: str) -> DataFrame:
    _, c = _log(spark, sf)
    return features.engage_similarity(c, _history(spark, sf)[1], U.vectors(spark, sf)).select("imp", "item", F.round("engage_sim", 6).alias("engage_sim"))


@query
def knn_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = U.vectors(spark, sf)
    found = retrieval.exact_knn(v.select(F.col("item").alias("query"), "v"), v, 10)
    return found.select("query", "item", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def knn_overfetch_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """For each list the nearest vectors of all, cut at 600, and of those the first 200 that were published."""
    v = U.vectors(spark, sf)
    dim = U.articles(spark, sf).select(F.col("article_id").alias("item"), "published_time")
    if (every := held.held_vectors(v, most=held.SEARCHED * held.HELD_ITEMS)) is not None:  # lists are searched where they stand, equal ones once, and only what is kept goes on
        times = held.held_times(every, dim.select("item", C.micros(F.col("published_time")).alias("us")), spark)
        i = U.impressions(U.events(spark, sf)).filter(F.size("history") > 0)
        i = i.select(F.col("impression_id").alias("query"), C.micros(F.col("timestamp")).alias("us"), C.last_n(F.col("history"), 10).alias("recent"))
        i = i.groupBy("recent", "us").agg(F.collect_list("query").alias("queries")).select("queries", "us", held.user_means(every, F.col("recent")).alias("u"))
        lists = i.filter("u is not null").select("queries", held.published_nearest(every, times, F.col("u"), F.col("us"), retrieval.OVERFETCH, retrieval.KEEP).alias("items"))
        cut = lists.select("queries", F.size("items").cast("long").alias("n"), F.md5(_joined("items").cast("binary")).alias("items_md5")).filter("n > 0")
        return cut.select(F.explode("queries").alias("query"), "n", "items_md5")
    _, c = _log(spark, sf)
    h = _history(spark, sf)[1].filter("h > hist_len - 10")
    users = stored(retrieval.user_vectors(h, v, None, "imp"), "users")
    found = retrieval.exact_knn(users.select(F.col("imp").alias("query"), F.col("u").alias("v")), v, retrieval.OVERFETCH)
    at = c.select(F.col("imp").alias("query"), "ts").distinct()
    kept = retrieval.overfetch(found.join(at, "query"), dim, "query")
    return kept.groupBy("query").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x.item), ",").cast("binary")).alias("items_md5"))


def _index(spark: SparkSession, sf: str, **more) -> DataFrame:
    return retrieval.postings(spread(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id"), "doc_id", F.col("text"), **more)


@query
def bm25_postings_stats(spark: SparkSession, sf: str) -> DataFrame:
    i = _index(spark, sf)
    return i.groupBy("term").agg(F.max("df").alias("df"), F.sum("tf").alias("cf"), F.round(F.max("weight"), 6).alias("top_weight"))


@query
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.col("text").alias("query"))
    top = retrieval.top_k(retrieval.bm25_scores(b, _index(spark, sf)), 20, "query")
    return b.join(top, "query").select("item_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def _bm25(spark: SparkSession, sf: str, last: int = 5, base: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Candidates with the BM25 score of the titles of the last clicks; 0 where no term is shared."""
    c, h = base or (_log(spark, sf)[1], _history(spark, sf)[1])
    a = U.articles(spark, sf)
    index = retrieval.postings(a, "article_id", F.col("body"))
    h = h.filter(F.col("h") > F.col("hist_len") - last).join(a.select(F.col("article_id").alias("item"), "title"), "item")
    q = h.groupBy("imp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "title"))), lambda x: x.title), " ").alias("query"))
    return retrieval.pair_bm25(c, q, index)


@query
def bm25_pool_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf).select("imp", "item", F.round("bm25", 5).alias("bm25"))


@query
def bm25_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.col("text").alias("query"))
    top = retrieval.top_k(retrieval.bm25_scores(b, _index(spark, sf)), 50, "query").groupBy("query").agg(F.collect_list("doc_id").alias("retrieved"))
    lists = b.join(top, "query", "left").withColumn("clicked", F.array(F.col("item_id"), F.col("item_id") + 40, F.col("item_id") + 80))
    return metrics.hit_rate(lists.withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<bigint>"))).select(F.col("retrieved").cast("array<string>").alias("retrieved"), F.col("clicked").cast("array<string>").alias("clicked"))).select("lists", F.round("hit_rate", 6).alias("hit_rate"))


@query
def bm25_fields_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, terms and postings of two variants of an index: titles alone, and titles with bodies."""
    a = U.articles(spark, sf)
    out = None
    for name, fields in (("title", ("title",)), ("title and body", ("title", "abstract", "body"))):
        i = retrieval.postings(retrieval.fields_variant(a, fields), "article_id", F.col("text"))
        row = i.agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("term").alias("terms"), F.count("*").alias("postings"), F.round(F.sum("weight"), 3).alias("weight")).withColumn("variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query
def candidate_pools(spark: SparkSession, sf: str) -> DataFrame:
    """Size of the pool that lexical and dense retrieval make together, for each hundredth article as a query to all."""
    v = U.vectors(spark, sf)
    ask = v.filter("cast(item as long) % 100 = 0").select(F.col("item").alias("query"), "v")
    dense = retrieval.exact_knn(ask, v, 10)
    a = U.articles(spark, sf)
    q = a.filter("cast(article_id as long) % 100 = 0").select(F.col("article_id").alias("asked"), F.col("title").alias("query"))
    top = retrieval.bm25_top(q, retrieval.postings(a, "article_id", F.col("body")), a.count(), 10)
    lexical = q.join(top, "query").select(F.col("asked").alias("query"), F.col("doc_id").alias("item"))
    return retrieval.union_pools(dense, lexical).groupBy("query").agg(F.count("*").alias("pool"))


def _title_scores(titles: DataFrame, a: DataFrame, own: bool = False) -> DataFrame:
    """(item, doc_id, score) of each title against all articles that share a term with it, or against its own table's."""
    q = titles.select("item", F.col("title").alias("query"))
    if own and retrieval.unique_ids(a, "article_id"):
        index = retrieval.own_postings(a, "article_id", F.col("body"), retrieval.query_terms(q).select("term").distinct(), titles.select(F.col("item").alias("doc_id")))
    else:
        index = retrieval.postings(a, "article_id", F.col("body"))
        index = index.join(titles.select(F.col("item").alias("doc_id")), "doc_id", "left_semi") if own else index
    return q.join(retrieval.bm25_scores(q, index), "query").select("item", "doc_id", "score")


@query
def retrieval_track(spark: SparkSession, sf: str) -> DataFrame:
    """The lexical track: each list's titles ask all articles, 600 are fetched, 200 published ones kept; mean recall of the clicks by depth."""
    a = U.articles(spark, sf)
    dim = a.select(F.col("article_id").alias("item"), "published_time")
    depths = (50, 100, 200)
    titles = a.select(F.col("article_id").alias("item"), "title").join(U.events(spark, sf).filter("click").select("item").distinct(), "item")
    titles = stored(titles, "titles")
    pools = held.held_scores(titles.select("item"), lambda: _title_scores(titles, a), a.count())
    if pools is not None:  # a list's query is the sum of its titles, so lists are searched where they stand
        times = held.held_times((pools[1], None), dim.select("item", C.micros(F.col("published_time")).alias("us")), spark)
        i = U.impressions(U.events(spark, sf)).filter(F.size("clicked") > 0)
        i = i.select("clicked", held.published_best(pools[0], times, C.last_n(F.col("history"), 5), C.micros(F.col("timestamp")), retrieval.OVERFETCH, retrieval.KEEP).alias("retrieved"))
        r = metrics.recall_at(i.filter("retrieved is not null"), depths)
        return r.agg(F.count("*").alias("lists"), *(F.round(F.avg(f"recall_{k}"), 6).alias(f"recall_{k}") for k in depths))
    if retrieval.unique_ids(a, "article_id"):  # documents that come before a click are counted where documents stand
        q = titles.select("item", F.col("title").alias("query"))
        q = stored(q.join(retrieval.query_terms(q), "query").select("item", "term", "qtf"), "query")
        counts = stored(retrieval.term_counts(a, F.col("body"), q), "terms")
        docs = a.select(F.col("article_id").alias("doc_id"), C.micros(F.col("published_time")).alias("us"), retrieval.terms(F.col("body")).alias("t")).filter("doc_id is not null")
        i = U.impressions(U.events(spark, sf)).filter(F.size("clicked") > 0)
        i = i.select(C.last_n(F.col("history"), 5).alias("sources"), C.micros(F.col("timestamp")).alias("us"), "clicked")
        if (r := held.recalls(docs, titles.select("item"), q, counts, i, depths, retrieval.OVERFETCH, retrieval.KEEP, retrieval.K1, retrieval.B)) is not None:
            return r.select("lists", *(F.round(F.try_divide(f"recall_{k}", "lists"), 6).alias(f"recall_{k}") for k in depths))
    _, c = _log(spark, sf)
    h = _history(spark, sf)[1]
    titles = h.filter("h > hist_len - 5").join(a.select(F.col("article_id").alias("item"), "title"), "item")
    q = titles.groupBy("imp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "title"))), lambda x: x.title), " ").alias("query"))
    asked = stored(q.join(c.filter("label = 1").groupBy("imp", "ts").agg(F.collect_set("item").alias("clicked")), "imp"), "asked")
    fetched = retrieval.top_k(retrieval.bm25_scores(asked, retrieval.postings(a, "article_id", F.col("body"))), retrieval.OVERFETCH, "query")
    kept = retrieval.overfetch(asked.select("imp", "ts", "query").join(fetched, "query").withColumnRenamed("doc_id", "item"), dim, "imp")
    lists = kept.groupBy("imp").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x.item).alias("retrieved"))
    r = metrics.recall_at(asked.join(lists, "imp", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>"))), depths)
    return r.agg(F.count("*").alias("lists"), *(F.round(F.avg(f"recall_{k}"), 6).alias(f"recall_{k}") for k in depths))


@query
def bm25_stemmed_topk(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.stemming import stopwords

    words = stopwords(spark, "english")
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.col("text").alias("query"))
    scores = retrieval.bm25_scores(b, _index(spark, sf, language="english", stopwords=words), language="english", stopwords=words)
    return b.join(retrieval.top_k(scores, 20, "query"), "query").select("item_id", "doc_id", F.round("score", 5).alias("score"), "rank")


# --------------------------------------------------------------------- fusion


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    b = _bm25(spark, sf)
    return _emb(spark, sf).join(b.select("imp", "item", "bm25"), ["imp", "item"]).withColumns({"emb": F.round("emb", 9), "bm25": F.round("bm25", 9)})


@query
def zscore_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fused(_scores(spark, sf), "emb", "bm25", 0.6).select("imp", "item", (F.round("score", 5) + 0.0).alias("score"))


@query
def alpha_sweep(spark: SparkSession, sf: str) -> DataFrame:
    pop = _counts(spark, sf, {"pop": None, "day": 24.0}, True)
    return fusion.alpha_grid(pop, "pop", "day").select("alpha", "lists", F.round("auc", 6).alias("auc"))


@query
def alpha_best(spark: SparkSession, sf: str) -> DataFrame:
    pop = _counts(spark, sf, {"pop": None, "day": 24.0}, True)
    return fusion.best_alpha(fusion.alpha_grid(pop, "pop", "day")).select("alpha", F.round("auc", 6).alias("auc"))


@query
def entity_blend(spark: SparkSession, sf: str) -> DataFrame:
    e = features.entity_overlap(_emb(spark, sf), _history(spark, sf)[1], U.articles(spark, sf))
    e = e.withColumns({"emb": F.round("emb", 9), "ent_overlap": F.round("ent_overlap", 9)})
    return fusion.fused(e, "ent_overlap", "emb", L1.entity_alpha).select("imp", "item", (F.round("score", 5) + 0.0).alias("score"))


@query
def leaky_arm(spark: SparkSession, sf: str) -> DataFrame:
    a = U.articles(spark, sf).select(F.col("article_id").alias("item"), "total_inviews")
    pop = _counts(spark, sf, {"n": None}, True).join(a, "item", "left")
    return fusion.leaky(pop, "n", "total_inviews").select("imp", "item", (F.round("leaky", 5) + 0.0).alias("leaky"))


# -------------------------------------------------------------------- metrics


@query
def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.list_metrics(_counts(spark, sf, {"score": 24.0}, True), "imp")
    return m.select("imp", F.col("n").alias("n"), "n_pos", *(F.round(x, 6).alias(x) for x in metrics.METRICS))


@query
def auc_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.mean_metrics(metrics.list_metrics(_counts(spark, sf, {"score": None}, True), "imp").withColumn("system", F.lit("pop")), "system")


@query
def ranking_metrics_l2(spark: SparkSession, sf: str) -> DataFrame:
    o = U.order_log(spark, sf)
    return metrics.mean_metrics(metrics.list_metrics(o.withColumn("score", F.col("price")), "imp").withColumn("system", F.lit("price")), "system")


@query
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    pop = _counts(spark, sf, {"n": None}, True)
    top = pop.withColumn("r", ordinal_rank(F.col("n"), F.col("pos"), "imp")).groupBy("imp").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "item"))), lambda x: x.item).alias("retrieved"), F.collect_list(F.when(F.col("label") == 1, F.col("item"))).alias("clicked"))
    return metrics.recall_at(top.filter("size(clicked) > 0"), (1, 2, 5)).select("imp", *(F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in (1, 2, 5)))


def _top(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    pop = _counts(spark, sf, {"n": None}, True)
    return pop.withColumn("r", ordinal_rank(F.col("n"), F.col("pos"), "imp")).filter(F.col("r") <= k)


@query
def diversity(spark: SparkSession, sf: str) -> DataFrame:
    dim = U.articles(spark, sf).select(F.col("article_id").alias("item"), F.when(F.col("article_id").cast("int") % 9 != 0, F.col("category")).alias("category"))
    return beyond.diversity(_top(spark, sf).join(dim, "item", "left"), "imp").select("imp", F.round("diversity", 6).alias("diversity"))


def _train_clicks(spark: SparkSession, sf: str) -> DataFrame:
    ev = U.events(spark, sf)
    return ev.filter("click").filter(splits.split_of(F.col("ts"), L1) == "train").select("item")


@query
def novelty(spark: SparkSession, sf: str) -> DataFrame:
    counts = _train_clicks(spark, sf).filter("cast(item as int) % 10 <> 3").groupBy("item").agg(F.count("*").alias("n"))
    return beyond.novelty(_top(spark, sf), counts, "imp").select("imp", F.round("novelty", 6).alias("novelty"))


@query
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    top = _top(spark, sf, 1).withColumn("split", splits.split_of(F.col("ts"), L1))
    return beyond.coverage(top, U.articles(spark, sf), "split").select("split", "surfaced", "size", F.round("coverage", 6).alias("coverage"))


@query
def slices_cold_warm(spark: SparkSession, sf: str) -> DataFrame:
    i, _ = _history(spark, sf)
    s = beyond.cold_warm(i.select("impression_id", F.size("history").alias("hist_len")))
    return s.groupBy("slice").agg(F.count("*").alias("n"), F.min("hist_len").cast("long").alias("lo"), F.max("hist_len").cast("long").alias("hi")).filter("n >= 30")


@query
def slices_head_tail(spark: SparkSession, sf: str) -> DataFrame:
    _, c = _log(spark, sf)
    s = beyond.head_tail(c.select("imp").distinct(), c.filter("label = 1").select("imp", "item"), _train_clicks(spark, sf))
    return s.groupBy("slice").agg(F.count("*").alias("n"), F.max("popularity").cast("long").alias("hi")).filter("n >= 30")


@query
def slice_report(spark: SparkSession, sf: str) -> DataFrame:
    pop = _counts(spark, sf, {"score": 24.0}, True)
    m = metrics.list_metrics(pop, "imp").join(pop.select("imp", "ts").distinct(), "imp").withColumn("slice", splits.split_of(F.col("ts"), L1))
    return metrics.mean_metrics(m, "slice").filter("lists >= 30").select("slice", "lists", "auc_ordinal", "auc_midrank", "ndcg_10")


@query
def length_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").select("lang", F.char_length("text").alias("n"))
    return d.groupBy("lang").agg(F.count("*").alias("rows"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"), F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95"))


@query
def compare_arms(spark: SparkSession, sf: str) -> DataFrame:
    d = metrics.compare_scored(_counts(spark, sf, {"score": None}, True), _counts(spark, sf, {"score": 24.0}, True))
    return d.agg(F.count("*").alias("lists"), F.round(F.avg("a"), 6).alias("a"), F.round(F.avg("b"), 6).alias("b"), F.round(F.avg("delta"), 6).alias("delta"), F.count(F.when(F.col("delta") > 1e-12, 1)).alias("better"))


@query
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.list_metrics(_counts(spark, sf, {"score": 24.0}, True), "imp").withColumn("system", F.lit("pop_24h"))
    return stats.exact_interval(m, "auc_midrank", "imp", "system")


@query
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    a = metrics.list_metrics(_counts(spark, sf, {"score": None}, True), "imp")
    b = metrics.list_metrics(_counts(spark, sf, {"score": 24.0}, True), "imp")
    return stats.poisson_interval(metrics.compare(a, b, "auc_midrank", "imp"), "delta", "imp")


@query
def coverage_spread(spark: SparkSession, sf: str) -> DataFrame:
    return stats.coverage_spread(_top(spark, sf, 1), U.articles(spark, sf).count())


# -------------------------------------------------------------------- quality


def _split_imps(spark: SparkSession, sf: str) -> DataFrame:
    return splits.recency_seconds(U.impressions(U.events(spark, sf))).withColumn("split", splits.split_of(F.col("timestamp"), L1))


@query
def quality_split_order(spark: SparkSession, sf: str) -> DataFrame:
    return splits.check_split_order(_split_imps(spark, sf))


@query
def quality_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The row-level checks, and the same with a fault put in, which each must find."""
    i = _split_imps(spark, sf)
    bad = i.withColumn("history_timestamps", F.when(F.col("impression_id") % 10 == 0, F.concat("history_timestamps", F.array("timestamp"))).otherwise(F.col("history_timestamps"))).withColumn("clicked", F.when(F.col("impression_id") % 10 == 1, F.concat("clicked", F.array(F.lit("no such")))).otherwise(F.col("clicked")))
    bad = bad.withColumn("recency_seconds", F.when((F.col("impression_id") % 10 == 2) & F.col("recency_seconds").isNotNull(), F.lit(0.0)).otherwise(F.col("recency_seconds")))
    out = None
    for name, frame in (("as it is", i), ("poisoned", bad)):
        for check in (splits.check_history_past, splits.check_clicked_subset, splits.check_lengths, splits.check_recency):
            row = check(frame).select(F.lit(name).alias("log"), "check", "compared", "violations")
            out = row if out is None else out.unionByName(row)
    return out


@query
def quality_ids(spark: SparkSession, sf: str) -> DataFrame:
    i, a = _split_imps(spark, sf), U.articles(spark, sf)
    return splits.check_ids(i, a.filter("cast(article_id as int) % 20 <> 5")).unionByName(splits.check_published(i, a))


@query
def quality_coverage(spark: SparkSession, sf: str) -> DataFrame:
    _, c = _log(spark, sf)
    v = U.vectors(spark, sf)
    return splits.check_coverage(c, v, "item").withColumn("ids", F.lit("all")).unionByName(splits.check_coverage(c, v.filter("cast(item as int) % 10 <> 0"), "item").withColumn("ids", F.lit("nine tenths")))


# --------------------------------------------------------------------- export


@query
def rank_export(spark: SparkSession, sf: str) -> DataFrame:
    return export.lines(export.rank_lists(_counts(spark, sf, {"score": None}, True)))


@query
def rank_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Validates the exported lines, and again with ranks doubled, rows cut short and ids swapped."""
    c = _counts(spark, sf, {"score": None}, True)
    expected = splits.numbered(c.groupBy("imp").agg(F.count("*").alias("n")), "imp").select("row", F.col("imp").cast("string").alias("id"), "n")
    parsed = export.parse(export.lines(export.rank_lists(c)))
    good = expected.select("row", "id").join(parsed, "id")
    r = F.col("ranks")
    bad = good.withColumn("id", F.when(F.col("row") % 7 == 3, F.lit("no such")).otherwise(F.col("id"))).withColumn("ranks", F.when((F.col("row") % 7 == 1) & (F.size(r) > 1), F.concat(F.array(F.element_at(r, 2)), F.slice(r, 2, 1000))).when(F.col("row") % 7 == 2, F.concat(r, F.array(F.lit(1)))).otherwise(r))
    return export.validate(good, expected).withColumn("file", F.lit("good")).unionByName(export.validate(bad, expected).withColumn("file", F.lit("bad")))


@query
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return splits.seeded_sample(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand"), "p_partkey", 100)


# --------------------------------------------------------------------- sweeps


@query
def sweep_halflife(spark: SparkSession, sf: str) -> DataFrame:
    _, c = _log(spark, sf)
    dim = U.articles(spark, sf).select(F.col("article_id").alias("item"), "published_time")
    rows = c.join(dim, "item", "left").withColumn("half_life", F.explode(F.array(*map(F.lit, (6.0, 24.0, 72.0, 240.0)))))
    scored = rows.withColumn("score", F.round(C.decay(C.hours_between(F.col("ts"), F.col("published_time")), F.col("half_life")), 9))
    return metrics.list_metrics(scored, "imp", "half_life").groupBy("half_life").agg(F.count("*").alias("lists"), F.round(F.avg("auc_midrank"), 6).alias("auc"))


@query
def sweep_window(spark: SparkSession, sf: str) -> DataFrame:
    hours = {"w1": 1.0, "w6": 6.0, "w24": 24.0, "w72": 72.0, "past": None}
    wide = _counts(spark, sf, hours, True)
    rows = wide.select("imp", "pos", "label", F.explode(F.create_map(*[x for h in hours for x in (F.lit(h), F.col(h))])).alias("window", "score"))
    return metrics.list_metrics(rows, "imp", "window").groupBy("window").agg(F.count("*").alias("lists"), F.round(F.avg("auc_midrank"), 6).alias("auc"))


LASTS = (1, 5, 10, 50)


def _history_scores(spark: SparkSession, sf: str, weighted: bool) -> tuple[DataFrame, tuple[str, ...]]:
    """(user_id, imp, last, pos, label, score) of the cosine with the user vector of the last n clicks, and what names a list.

    Lists are scored where they stand, by user, while all tasks can hold the vectors that lists meet; else by joins.
    """
    weight = lambda read: F.log1p(F.greatest(C.number_or_zero(read), F.lit(0.0)))
    v, ev = U.vectors(spark, sf), U.events(spark, sf)
    if (every := held.held_vectors(v, met=ev)) is None:
        h = _history(spark, sf)[1].withColumn("last", F.explode(F.array(*map(F.lit, LASTS)))).filter(F.col("h") > F.col("hist_len") - F.col("last"))
        users = retrieval.user_vectors(h, v, weight(F.col("read_time")) if weighted else None, "imp", "last")
        return _log(spark, sf)[1].join(users, "imp").join(v, "item").withColumn("score", F.round(C.dot(F.col("u"), F.col("v")), 7)), ("imp", "last")
    i = U.impressions(ev)
    w = F.transform(C.last_n(F.col("read_times"), max(LASTS)), lambda r: retrieval.positive(weight(r) if weighted else None))
    cosines = held.last_cosines(every, C.last_n(F.col("history"), max(LASTS)), w, F.col("candidates"), LASTS)
    at = F.transform("candidates", lambda x: F.array_contains("clicked", x).cast("int"))
    rows = i.select("user_id", F.col("impression_id").alias("imp"), at.alias("labels"), *(s.alias(f"s{k}") for k, s in enumerate(cosines)))
    names = [f"s{k}" for k in range(len(LASTS))]
    each = rows.select("user_id", "imp", F.posexplode(F.arrays_zip("labels", *names)).alias("at", "x"))
    scores = F.array(*(F.struct(F.lit(n).alias("last"), F.round(F.col(f"x.{s}"), 7).alias("score")) for n, s in zip(LASTS, names)))
    each = each.select("user_id", "imp", (F.col("at") + 1).alias("pos"), F.col("x.labels").alias("label"), F.explode(scores).alias("y"))
    return each.select("user_id", "imp", "pos", "label", "y.last", "y.score").filter("score is not null"), ("user_id", "imp", "last")


def _history_sweep(spark: SparkSession, sf: str, weighted: bool) -> DataFrame:
    scored, by = _history_scores(spark, sf, weighted)
    return metrics.list_metrics(scored, *by).groupBy("last").agg(F.count("*").alias("lists"), F.round(F.avg("auc_midrank"), 4).alias("auc"))


@query
def sweep_history_n(spark: SparkSession, sf: str) -> DataFrame:
    """Mean AUC of the cosine with the user vector of the last n clicks, by n."""
    return _history_sweep(spark, sf, False)


@query
def sweep_history_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """As ``sweep_history_n``, with clicks weighted by their read time."""
    return _history_sweep(spark, sf, True)


@query
def sweep_scroll(spark: SparkSession, sf: str) -> DataFrame:
    """Share of history kept over scroll thresholds, and users left."""
    h = _history(spark, sf)[1].withColumn("least", F.explode(F.array(*map(F.lit, (0.0, 25.0, 50.0, 90.0)))))
    return h.groupBy("least").agg(F.round(F.avg((F.col("scroll") >= F.col("least")).cast("double")), 6).alias("kept"), F.countDistinct(F.when(F.col("scroll") >= F.col("least"), F.col("imp"))).alias("users"))


# --------------------------------------------------------------------- ranker


def _trainable(spark: SparkSession, sf: str) -> DataFrame:
    ev, c = _log(spark, sf)
    p = features.popularities(c, ev, None)
    a = U.articles(spark, sf)
    p = features.leaky_features(features.freshness(p, a), a).withColumn("n_cands", F.count("*").over(Window.partitionBy("imp")))
    return p.withColumn("split", splits.split_of(F.col("ts"), L1))


RANKED = ("pop_causal", "pop_24h", "pop_rank", "exp_causal", "exp_rank", "exp_velocity", "age_hours", "recency", "n_cands")


def _arm(t: DataFrame, names: tuple[str, ...], settings: ranker.Settings) -> DataFrame:
    model = ranker.fit(t.filter("split = 'train'"), t.filter("split = 'val'"), names, settings)
    return ranker.predict(t.filter("split = 'test'"), model, settings.rate)


@query
def lambdamart_rerank(spark: SparkSession, sf: str) -> DataFrame:
    t = stored(_trainable(spark, sf), "trainable")
    return _arm(t, RANKED, ranker.Settings()).select("imp", "item", "label", "score")


@query
def causal_vs_leaky(spark: SparkSession, sf: str) -> DataFrame:
    """Mean test metrics of the causal arm and of the arm that also sees a lifetime total, on the same lists."""
    t = stored(_trainable(spark, sf), "trainable")
    s = ranker.Settings()
    arms = [_arm(t, names, s).withColumn("arm", F.lit(arm)) for arm, names in (("causal", RANKED), ("leaky", (*RANKED, "log_total_inviews")))]
    return metrics.mean_metrics(metrics.list_metrics(arms[0].unionByName(arms[1]), "imp", "arm"), "arm")


@query
def leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    """Mean test metrics with each of three groups of features left out."""
    t = stored(_trainable(spark, sf), "trainable")
    s = ranker.Settings()
    groups = {"all": (), "no popularity": ("pop_causal", "pop_24h", "pop_rank"), "no exposure": ("exp_causal", "exp_rank", "exp_velocity"), "no age": ("age_hours", "recency")}
    out = None
    for name, gone in groups.items():
        arm = _arm(t, tuple(f for f in RANKED if f not in gone), s).withColumn("arm", F.lit(name))
        out = arm if out is None else out.unionByName(arm)
    return metrics.mean_metrics(metrics.list_metrics(out, "imp", "arm"), "arm")


@query
def negative_sampling(spark: SparkSession, sf: str) -> DataFrame:
    _, c = _log(spark, sf)
    return ranker.negative_samples(c).select("imp", "item", _joined("negatives").alias("negatives"))


# ------------------------------------------------------------------ streaming


@query
def exposure_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Six-hour exposure counts by a stream over the events, run to the end."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("item", F.get_json_object("props", "$.k"))
    return run_to_end(hourly_exposures(stream), scratch(spark, "exposure-stream"))
