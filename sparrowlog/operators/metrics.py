"""Ranking metrics of one list at a time, from a long table (list, pos, label, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.windows import average_rank, ordinal_rank

CUTS = (5, 10)


def _ideal(n: Column, k: int) -> Column:
    gains = [0.0]
    for i in range(1, k + 1):
        gains.append(gains[-1] + 1.0)
    steps = F.array(*(F.lit(x) for x in range(1, k + 1)))
    return F.aggregate(F.filter(steps, lambda i: i <= n), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + F.lit(1.0)))


def list_metrics(scored: DataFrame, *by: str, score: str = "score", label: str = "label", pos: str = "pos") -> DataFrame:
    """One row a list that has both classes: n, n_pos, auc_ordinal, auc_midrank, mrr, mrr_all, ndcg_5, ndcg_10.

    Ordinal places break ties by position, mid-ranks share them; the two AUCs
    differ on ties.  mrr: 1 / place of the first click; mrr_all: mean over clicks.
    """
    s = F.col(score).cast("double")
    ranked = scored.withColumn("__s", s).withColumn("__r", ordinal_rank(F.col("__s"), F.col(pos), *by)).withColumn("__a", average_rank(F.col("__s"), *by))
    y = F.col(label).cast("int")
    gain = lambda k: F.sum(F.when((y == 1) & (F.col("__r") <= k), F.lit(1.0) / F.log2(F.col("__r") + F.lit(1.0))).otherwise(0.0))
    g = ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(y).cast("long").alias("n_pos"), F.sum(F.when(y == 1, F.col("__r"))).alias("down"), F.sum(F.when(y == 1, F.col("__a"))).alias("up"),
        F.min(F.when(y == 1, F.col("__r"))).alias("first"), F.avg(F.when(y == 1, F.lit(1.0) / F.col("__r"))).alias("mrr_all"), *(gain(k).alias(f"dcg_{k}") for k in CUTS),
    ).filter("n_pos > 0 and n_pos < n")
    p, q = F.col("n_pos").cast("double"), (F.col("n") - F.col("n_pos")).cast("double")
    return g.select(
        *by, "n", "n_pos", ((F.lit(1.0) * p * (F.col("n") + 1) - F.col("down") - p * (p + 1) / 2) / (p * q)).alias("auc_ordinal"), ((F.col("up") - p * (p + 1) / 2) / (p * q)).alias("auc_midrank"),
        (F.lit(1.0) / F.col("first")).alias("mrr"), "mrr_all", *((F.col(f"dcg_{k}") / _ideal(F.col("n_pos"), k)).alias(f"ndcg_{k}") for k in CUTS),
    )


METRICS = ("auc_ordinal", "auc_midrank", "mrr", "mrr_all", "ndcg_5", "ndcg_10")


def mean_metrics(per_list: DataFrame, *by: str) -> DataFrame:
    return per_list.groupBy(*by).agg(F.count("*").alias("lists"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS))


def recall_at(lists: DataFrame, cuts: tuple[int, ...] = (50, 100, 200), retrieved: str = "retrieved", clicked: str = "clicked") -> DataFrame:
    """Adds recall_k: the share of the clicks among the first k retrieved; 0 for an empty or null list.

    The intersection counts an item once, the denominator each click.
    """
    got = F.coalesce(F.col(retrieved), F.array().cast("array<string>"))
    n = F.size(clicked)
    return lists.withColumns({f"recall_{k}": F.when(n > 0, F.size(F.array_intersect(F.slice(got, 1, k), F.col(clicked))) / n) for k in cuts})


def hit_rate(lists: DataFrame, retrieved: str = "retrieved", clicked: str = "clicked") -> DataFrame:
    """Share of all lists of which at least one click was retrieved."""
    got = F.coalesce(F.col(retrieved), F.array().cast("array<string>"))
    return lists.agg(F.count("*").alias("lists"), F.avg((F.size(F.array_intersect(got, F.col(clicked))) > 0).cast("double")).alias("hit_rate"))


def compare(a: DataFrame, b: DataFrame, metric: str, *by: str) -> DataFrame:
    """Paired differences (b - a) over the lists that both have."""
    return a.select(*by, F.col(metric).alias("a")).join(b.select(*by, F.col(metric).alias("b")), list(by)).withColumn("delta", F.col("b") - F.col("a"))


def require_same_lists(a: DataFrame, b: DataFrame, by: str = "imp") -> None:
    """An error if two scored arms differ in their lists, in a list's candidates or in a label."""
    x, y = (d.select(by, "pos", F.col("label").cast("int").alias(f"label_{c}")) for d, c in ((a, "a"), (b, "b")))
    row = x.join(y, [by, "pos"], "full_outer").agg(F.count_if(F.col("label_a").isNull() | F.col("label_b").isNull()).alias("alone"), F.count_if(F.col("label_a") != F.col("label_b")).alias("unlike")).first()
    if row.alone or row.unlike:
        raise ValueError(f"arms differ: {row.alone} candidates in one of them only, {row.unlike} with other labels")


def compare_scored(a: DataFrame, b: DataFrame, metric: str = "auc_midrank", by: str = "imp") -> DataFrame:
    """``compare`` of two scored arms over the same lists, which is checked first."""
    require_same_lists(a, b, by)
    return compare(list_metrics(a, by), list_metrics(b, by), metric, by)
