"""The stages of the offline pipeline, each a function from a folder to a folder.

split -> retrieve -> score -> fuse -> features -> train -> evaluate -> submit.  A stage
reads the Parquet of the one before and writes its own; a folder with
``_SUCCESS`` is whole.  ``main`` runs them by name.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Dataset, datasets
from ..functions.columns import micros
from ..functions.stemming import stopwords
from ..functions.windows import ordinal_rank
from ..operators import beyond, export, features, fusion, metrics, ranker, retrieval, splits, stats
from ..sources.files import read_vectors, write_report, write_sorted
from ..sources.logs import LOADERS, RECORDS
from ..session import session


def split(spark: SparkSession, cfg: Dataset, raw: str, work: str) -> None:
    imps, articles = LOADERS[cfg.loader](spark, raw)
    imps.withColumn("split", splits.split_of(F.col("timestamp"), cfg)).write.mode("overwrite").partitionBy("split").parquet(f"{work}/impressions")
    write_sorted(articles, f"{work}/articles", "article_id")
    if cfg.loader in RECORDS:
        RECORDS[cfg.loader](spark, raw).write.mode("overwrite").parquet(f"{work}/engagement")


def _grain(spark: SparkSession, work: str, splits_: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Impressions, candidates (imp, ts, us, pos, item, label, split) and history (imp, h, item, hist_len)."""
    i = spark.read.parquet(f"{work}/impressions")
    i = i.filter(F.col("split").isin(*splits_)) if splits_ else i
    us = micros(F.col("timestamp"))
    c = i.select(F.col("impression_id").alias("imp"), F.col("timestamp").alias("ts"), us.alias("us"), "split", "clicked", F.posexplode("candidates").alias("p", "item"))
    c = c.select("imp", "ts", "us", "split", (F.col("p") + 1).alias("pos"), "item", F.array_contains("clicked", F.col("item")).cast("int").alias("label"))
    h = i.select(F.col("impression_id").alias("imp"), F.size("history").alias("hist_len"), F.posexplode("history").alias("p", "item")).select("imp", (F.col("p") + 1).alias("h"), "item", "hist_len")
    return i, c, h


def _lexical(spark: SparkSession, cfg: Dataset, work: str, h: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """(imp, query) of the recent titles, the index of all articles, and how both read words."""
    a = spark.read.parquet(f"{work}/articles")
    how = {"stopwords": stopwords(spark, cfg.language), "language": cfg.language if cfg.stem else None}
    titled = h.filter(F.col("h") > F.col("hist_len") - cfg.history_len).join(a.select(F.col("article_id").alias("item"), "title"), "item")
    q = titled.groupBy("imp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "title"))), lambda x: x.title), " ").alias("query"))
    return q, retrieval.postings(a, "article_id", retrieval.document_text(a, cfg.fields), **how), how


def retrieve(spark: SparkSession, cfg: Dataset, work: str, parts: tuple[str, ...] = ("val", "test")) -> None:
    """The lexical track: of the OVERFETCH best articles of each list's query the first KEEP that were published."""
    i, _, h = _grain(spark, work, parts)
    q, index, how = _lexical(spark, cfg, work, h)
    best = retrieval.top_k(retrieval.bm25_scores(q, index, **how), retrieval.OVERFETCH, "query").withColumnRenamed("doc_id", "item")
    asked = i.select(F.col("impression_id").alias("imp"), F.col("timestamp").alias("ts"), "split").join(q, "imp")
    dim = spark.read.parquet(f"{work}/articles").select(F.col("article_id").alias("item"), "published_time")
    kept = retrieval.overfetch(asked.join(best, "query"), dim, "imp")
    lists = kept.groupBy("imp").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x.item).alias("retrieved"))
    every = i.select(F.col("impression_id").alias("imp"), "split", "clicked").join(lists, "imp", "left")
    every.withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>"))).write.mode("overwrite").partitionBy("split").parquet(f"{work}/retrieval")


def score(spark: SparkSession, cfg: Dataset, vectors: str, work: str) -> None:
    """BM25 of recent titles and cosine of the mean recent vector, for each candidate."""
    _, c, h = _grain(spark, work)
    v = read_vectors(spark, vectors)
    recent = h.filter(F.col("h") > F.col("hist_len") - cfg.history_len)
    q, index, how = _lexical(spark, cfg, work, h)
    out = retrieval.pair_bm25(retrieval.pair_cosine(c, retrieval.user_vectors(recent, v, None, "imp"), v), q, index, **how)
    out.select("imp", "split", "pos", "item", "label", "bm25", "emb").write.mode("overwrite").partitionBy("split").parquet(f"{work}/scores")


def fuse(spark: SparkSession, cfg: Dataset, work: str) -> float:
    """The weight is tuned on val and used on all splits."""
    s = spark.read.parquet(f"{work}/scores")
    alpha = fusion.best_alpha(fusion.alpha_grid(s.filter("split = 'val'"), "emb", "bm25")).first().alpha or 0.5
    fusion.fused(s, "emb", "bm25", alpha).write.mode("overwrite").partitionBy("split").parquet(f"{work}/fused")
    return alpha


def _engaged(spark: SparkSession, work: str, i: DataFrame) -> DataFrame:
    """(imp, item, read_time, scroll): the records each impression's split may read."""
    imps = i.select(F.col("impression_id").alias("imp"), "user_id", "split")
    found = features.block_history(imps, spark.read.parquet(f"{work}/engagement"))
    z = F.arrays_zip(F.col("history").alias("item"), F.col("read_times").alias("read_time"), F.col("scrolls").alias("scroll"))
    return found.select("imp", F.explode(z).alias("x")).select("imp", "x.item", "x.read_time", "x.scroll")


def build(spark: SparkSession, cfg: Dataset, vectors: str, work: str) -> None:
    """The feature table; an item counts as exposed once each time it was shown, clicked or not."""
    i, c, h = _grain(spark, work)
    events = c.select("us", "item", (F.col("label") == 1).alias("click"))
    engaged = _engaged(spark, work, i) if "user_read" in cfg.features() else None
    table = features.feature_table(c, spark.read.parquet(f"{work}/scores"), events, h, spark.read.parquet(f"{work}/articles"), read_vectors(spark, vectors), cfg, engaged)
    keys = c.select("imp", "item", "pos", "split")
    table.join(keys, ["imp", "item"]).write.mode("overwrite").partitionBy("split").parquet(f"{work}/features")
    features.require_varied(spark.read.parquet(f"{work}/features").select("imp", *cfg.features()))


def train(spark: SparkSession, cfg: Dataset, work: str, settings: ranker.Settings = ranker.Settings()) -> ranker.Model:
    f = spark.read.parquet(f"{work}/features")
    model = ranker.fit(f.filter("split = 'train'"), f.filter("split = 'val'"), cfg.features(), settings)
    ranker.predict(f, model, settings.rate).select("imp", "split", "pos", "item", "label", "score").write.mode("overwrite").partitionBy("split").parquet(f"{work}/reranked")
    return model


SYSTEMS = ("bm25", "emb", "fused", "rerank")


def _slices(spark: SparkSession, work: str, part: str) -> DataFrame:
    """(imp, slice): every list is in "all", in one slice by its history's length and in one by its clicks' popularity."""
    i, c, _ = _grain(spark, work, (part,))
    train = _grain(spark, work, ("train",))[1].filter("label = 1").select("item")
    lists = i.select(F.col("impression_id").alias("imp"), F.size("history").alias("hist_len"))
    by_history = beyond.cold_warm(lists).select("imp", "slice")
    by_clicks = beyond.head_tail(lists, c.filter("label = 1").select("imp", "item"), train).select("imp", "slice")
    return lists.select("imp", F.lit("all").alias("slice")).unionByName(by_history).unionByName(by_clicks)


def _ranked(spark: SparkSession, work: str, part: str) -> DataFrame:
    """(imp, pos, item, label, system, score) of the lists that every system has."""
    s = spark.read.parquet(f"{work}/fused").filter(F.col("split") == part)
    r = spark.read.parquet(f"{work}/reranked").filter(F.col("split") == part).select("imp", "pos", F.col("score").alias("rerank"))
    wide = s.withColumnRenamed("score", "fused").join(r, ["imp", "pos"])
    systems = F.explode(F.create_map(*[x for name in SYSTEMS for x in (F.lit(name), F.col(name))])).alias("system", "score")
    return wide.select("imp", "pos", "item", "label", systems)


def evaluate(spark: SparkSession, cfg: Dataset, work: str, part: str = "test", least: int = 1) -> DataFrame:
    """(system, slice, lists, metrics, lo, hi): means over the lists of each slice and the interval of the mid-rank AUC; slices of fewer than ``least`` lists are left out."""
    m = metrics.list_metrics(_ranked(spark, work, part), "imp", "system").join(_slices(spark, work, part), "imp")
    spread = stats.poisson_interval(m, "auc_midrank", "imp", "system", "slice").select("system", "slice", "lo", "hi")
    return metrics.mean_metrics(m, "system", "slice").filter(F.col("lists") >= least).join(spread, ["system", "slice"])


def evaluate_beyond(spark: SparkSession, cfg: Dataset, work: str, part: str = "test", k: int = 10) -> DataFrame:
    """(system, diversity, novelty, coverage) of the first k of each list."""
    ranked = _ranked(spark, work, part).withColumn("r", ordinal_rank(F.col("score"), F.col("pos"), "imp", "system")).filter(F.col("r") <= k)
    a = spark.read.parquet(f"{work}/articles")
    counts = _grain(spark, work, ("train",))[1].filter("label = 1").groupBy("item").agg(F.count("*").alias("n"))
    top = ranked.join(a.select(F.col("article_id").alias("item"), "category"), "item", "left")
    mean = lambda f, name: f.groupBy("system").agg(F.round(F.avg(name), 6).alias(name))
    out = mean(beyond.diversity(top, "imp", "system"), "diversity").join(mean(beyond.novelty(top, counts, "imp", "system"), "novelty"), "system")
    return out.join(beyond.coverage(top, a, "system").select("system", F.round("coverage", 6).alias("coverage")), "system")


def evaluate_retrieval(spark: SparkSession, cfg: Dataset, work: str, part: str = "test", cuts: tuple[int, ...] = (50, 100, 200)) -> DataFrame:
    """(slice, lists, recall at each cut) of the lexical track, paired by slice."""
    lists = spark.read.parquet(f"{work}/retrieval").filter((F.col("split") == part) & (F.size("clicked") > 0))
    r = metrics.recall_at(lists, cuts).join(_slices(spark, work, part), "imp")
    return r.groupBy("slice").agg(F.count("*").alias("lists"), *(F.round(F.avg(f"recall_{k}"), 6).alias(f"recall_{k}") for k in cuts))


def submit(spark: SparkSession, cfg: Dataset, work: str, out: str, part: str = "test") -> None:
    scored = spark.read.parquet(f"{work}/reranked").filter(F.col("split") == part)
    export.write_lines(export.rank_lists(scored), out)


STAGES: dict[str, Callable] = {"split": split, "retrieve": retrieve, "score": score, "fuse": fuse, "features": build, "train": train, "evaluate": evaluate, "submit": submit}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=[*STAGES, "all"])
    p.add_argument("dataset")
    p.add_argument("--config", required=True)
    p.add_argument("--raw")
    p.add_argument("--vectors")
    p.add_argument("--work", required=True)
    p.add_argument("--history-len", type=int)
    p.add_argument("--stem", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--pop-window-h", type=float)
    a = p.parse_args(argv)
    from dataclasses import replace

    changed = {k: v for k, v in (("history_len", a.history_len), ("stem", a.stem), ("pop_window_h", a.pop_window_h)) if v is not None}
    cfg, spark = replace(datasets(a.config)[a.dataset], **changed), session()
    more = {"split": (a.raw, a.work), "score": (a.vectors, a.work), "features": (a.vectors, a.work), "submit": (a.work, f"{a.work}/prediction")}
    for name in STAGES if a.stage == "all" else [a.stage]:
        out = STAGES[name](spark, cfg, *more.get(name, (a.work,)))
        if name == "evaluate":
            report = {"systems": [r.asDict() for r in out.orderBy("system", "slice").collect()]}
            report["beyond"] = [r.asDict() for r in evaluate_beyond(spark, cfg, a.work).orderBy("system").collect()]
            report["retrieval"] = [r.asDict() for r in evaluate_retrieval(spark, cfg, a.work).orderBy("slice").collect()]
            write_report(report, f"{a.work}/report.json")


if __name__ == "__main__":
    main()
