"""Temporal splits, article dedup, recency and the quality checks over a normalised log.

Every check returns one row with the number of rows it could compare and the
number that break the rule, so that a check that compared nothing shows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Dataset
from ..shared import stored


def split_of(ts: Column, dataset: Dataset) -> Column:
    """train before val_start, val before test_start, then test; half-open."""
    val, test = (F.to_timestamp_ntz(F.lit(x)) for x in (dataset.val_start, dataset.test_start))
    return F.when(ts < val, "train").when(ts < test, "val").otherwise("test")


def keep_first(sources: list[DataFrame], key: str) -> DataFrame:
    """Union of frames of one schema; of a key the row of the earliest frame, within it the least by all columns."""
    numbered = [s.withColumn("__n", F.lit(i)) for i, s in enumerate(sources)]
    whole = numbered[0]
    for s in numbered[1:]:
        whole = whole.unionByName(s)
    plain = [c for c, t in whole.dtypes if c not in (key, "__n") and not t.startswith("map")]
    w = Window.partitionBy(key).orderBy("__n", *plain)
    return whole.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__n")


def recency_seconds(imps: DataFrame) -> DataFrame:
    """Adds recency_seconds: whole seconds since the latest history event; null, never 0, without any."""
    latest = F.array_max("history_timestamps")
    us = F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(latest.cast("timestamp"))
    return imps.withColumn("recency_seconds", F.floor(us / F.lit(1e6)).cast("double"))


def _check(df: DataFrame, name: str, comparable: Column, wrong: Column) -> DataFrame:
    return df.agg(F.lit(name).alias("check"), F.count(F.when(comparable, 1)).alias("compared"), F.count(F.when(comparable & wrong, 1)).alias("violations"))


def check_split_order(imps: DataFrame, split: str = "split", ts: str = "timestamp") -> DataFrame:
    """(split, lo, hi, n) with follows: whether it starts after all earlier splits end."""
    order = F.when(F.col(split) == "train", 0).when(F.col(split) == "val", 1).otherwise(2)
    per = imps.groupBy(split).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.count("*").alias("n")).withColumn("o", order)
    before = F.max("hi").over(Window.orderBy("o").rowsBetween(Window.unboundedPreceding, -1))  # three rows
    return per.withColumn("follows", F.coalesce(F.col("lo") > before, F.lit(True))).drop("o")


def check_history_past(imps: DataFrame) -> DataFrame:
    """No history event at or after its impression; null and empty histories can't be compared."""
    return _check(imps, "history_past", F.coalesce(F.size("history_timestamps"), F.lit(0)) > 0, F.array_max("history_timestamps") >= F.col("timestamp"))


def check_recency(imps: DataFrame) -> DataFrame:
    """Whole seconds since the last event are over 0, or null without any."""
    return _check(imps, "recency_positive", F.col("recency_seconds").isNotNull(), F.col("recency_seconds") <= 0)


def check_clicked_subset(imps: DataFrame) -> DataFrame:
    return _check(imps, "clicked_subset", F.size("clicked") > 0, F.size(F.array_except("clicked", "candidates")) > 0)


def check_lengths(imps: DataFrame) -> DataFrame:
    return _check(imps, "history_lengths", F.col("history_timestamps").isNotNull(), F.size("history") != F.size("history_timestamps"))


def check_ids(imps: DataFrame, articles: DataFrame) -> DataFrame:
    """Ids of candidates, clicks and histories that are empty or that no article has."""
    used = imps.select(F.explode(F.concat("candidates", "clicked", "history")).alias("item")).distinct()
    known = articles.select(F.col("article_id").alias("item"), F.lit(True).alias("known"))
    return _check(used.join(known, "item", "left"), "ids_resolve", F.lit(True), F.col("known").isNull() | (F.col("item") == ""))


def check_published(imps: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles published after the last impression: counted, not forbidden."""
    end = imps.agg(F.max("timestamp").alias("end"))
    return _check(articles.crossJoin(F.broadcast(end)), "published_after", F.col("published_time").isNotNull(), F.col("published_time") > F.col("end"))  # one row


def check_aligned(imps: DataFrame, scores: str) -> DataFrame:
    """Score lists as long as their candidates."""
    return _check(imps, "scores_aligned", F.col(scores).isNotNull(), F.size(scores) != F.size("candidates"))


def check_coverage(wanted: DataFrame, found: DataFrame, key: str, least: float = 0.95) -> DataFrame:
    """Share of wanted ids that are found."""
    ids = wanted.select(key).distinct().join(found.select(key, F.lit(1).alias("f")).distinct(), key, "left")
    return ids.agg(F.count("*").alias("wanted"), F.count("f").alias("found")).withColumn("enough", F.col("found") >= F.lit(least) * F.col("wanted"))


def require_covered(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``found`` restricted to the wanted ids; an error if one is missing."""
    missing = wanted.select(key).distinct().join(found, key, "left_anti")
    sample = [r[0] for r in missing.limit(5).collect()]
    if sample:
        raise ValueError(f"no {key} for {sample} ...")
    return found.join(wanted.select(key).distinct(), key, "left_semi")


def require_unique_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that neither misses nor multiplies rows; an error else."""
    once = right.groupBy(*keys).count().filter("count > 1").limit(1).count()
    if once:
        raise ValueError(f"{keys} are not unique on the right")
    if left.join(right, keys, "left_anti").limit(1).count():
        raise ValueError(f"rows without match on {keys}")
    return left.join(right, keys, "left")


def numbered(df: DataFrame, key: str, name: str = "row") -> DataFrame:
    """``df`` with each row's place from 1 in order of a unique key.

    Rows are dealt into ranges of the key and numbered within them; what lies
    before a range is one number a range, summed on the driver.
    """
    ranged = stored(df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, key).withColumn("__chunk", F.spark_partition_id()), "numbered")
    before, bases = 0, []
    for r in sorted(ranged.groupBy("__chunk").agg(F.count("*").alias("n")).collect()):
        bases.append((r[0], before))
        before += r.n
    base = df.sparkSession.createDataFrame(bases, "__chunk int, __before long")
    inside = F.row_number().over(Window.partitionBy("__chunk").orderBy(key))
    return ranged.withColumn(name, inside).join(F.broadcast(base), "__chunk").withColumn(name, F.col(name) + F.col("__before")).drop("__chunk", "__before")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 13) -> DataFrame:
    """n rows without replacement, by hash of the key and a seed: the same rows however partitioned."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)
