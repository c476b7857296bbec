"""Beyond accuracy: diversity, novelty and coverage of the top of each list; slices of lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def diversity(top: DataFrame, *by: str, category: str = "category") -> DataFrame:
    """Share of unlike category pairs in each list; null equals null; under two items 0.

    By category counts, not by pairs: 1 - sum c (c - 1) / (n (n - 1)).
    """
    per = top.groupBy(*by, category).agg(F.count("*").alias("c"))
    n = F.sum("c")
    return per.groupBy(*by).agg(F.when(n < 2, F.lit(0.0)).otherwise(1 - F.sum(F.col("c") * (F.col("c") - 1)) / (n * (n - 1))).alias("diversity"))


def novelty(top: DataFrame, counts: DataFrame, *by: str, item: str = "item") -> DataFrame:
    """Mean self-information of each list's items; ``counts`` has (item, n).  Unseen items count as one of total + 1."""
    total = counts.agg(F.sum("n").alias("total"))
    joined = top.select(*by, item).join(counts.select(item, F.col("n").alias("__n")), item, "left").crossJoin(F.broadcast(total))  # one row
    total = F.coalesce("total", F.lit(0)).cast("double")
    bits = F.when(F.col("__n").isNull(), F.log2(total + 1)).otherwise(-F.log2(F.col("__n") / total))
    return joined.groupBy(*by).agg(F.avg(bits).alias("novelty"))


def coverage(top: DataFrame, catalogue: DataFrame, *by: str, item: str = "item") -> DataFrame:
    """Distinct items surfaced over the size of the catalogue."""
    size = catalogue.agg(F.countDistinct("article_id").alias("size"))
    return top.groupBy(*by).agg(F.countDistinct(item).alias("surfaced")).crossJoin(F.broadcast(size)).withColumn("coverage", F.col("surfaced") / F.col("size"))


def cold_warm(lists: DataFrame, length: str = "hist_len", share: float = 0.1) -> DataFrame:
    """Adds slice: zero_history, cold (up to the given percentile of history length) or warm."""
    edge = lists.agg(F.percentile(length, F.lit(share)).alias("edge"))
    kind = F.when(F.col(length) == 0, "zero_history").when(F.col(length) <= F.col("edge"), "cold").otherwise("warm")
    return lists.crossJoin(F.broadcast(edge)).withColumn("slice", kind)


def head_tail(lists: DataFrame, clicks: DataFrame, train: DataFrame, share: float = 0.8, by: str = "imp") -> DataFrame:
    """Adds popularity (most train clicks of a clicked item) and slice: head at or over the percentile of positive values."""
    counts = train.groupBy("item").agg(F.count("*").alias("n"))
    best = clicks.join(counts, "item", "left").groupBy(by).agg(F.max(F.coalesce("n", F.lit(0))).alias("popularity"))
    known = lists.join(best, by, "left").withColumn("popularity", F.coalesce("popularity", F.lit(0)))
    edge = known.filter("popularity > 0").agg(F.coalesce(F.percentile("popularity", F.lit(share)), F.lit(0.0)).alias("edge"))
    return known.crossJoin(F.broadcast(edge)).withColumn("slice", F.when(F.col("popularity") >= F.col("edge"), "head").otherwise("tail"))
