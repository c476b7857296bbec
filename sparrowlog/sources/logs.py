"""Adapters from the two raw log shapes to the normalised model.

``nested``: Parquet with list columns, histories per user in one file a block.
``packed``: headerless tab-separated text with space-packed ids.
A loader takes a session and a folder and gives (impressions, articles).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import ARTICLE, IMPRESSION
from ..functions.columns import clock_12h, entity_labels, packed_pairs, tokens, union_keep_order
from ..operators.splits import keep_first, recency_seconds


def conform(df: DataFrame, schema) -> DataFrame:
    """The schema's columns in its order and types; those that are missing as typed nulls."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def _strings(items: str) -> Column:
    return F.transform(items, lambda x: x.cast("string"))


def nested_impressions(behaviors: DataFrame, history: DataFrame) -> DataFrame:
    """Left join on the user, so users without history stay, with an empty one; clicks may be absent (a scoring set)."""
    empty = F.array().cast("array<string>")
    h = history.select(F.col("user_id").cast("string").alias("user_id"), _strings("article_id_fixed").alias("history"), F.col("impression_time_fixed").cast("array<timestamp_ntz>").alias("history_timestamps"))
    clicked = F.coalesce(_strings("article_ids_clicked"), empty) if "article_ids_clicked" in behaviors.columns else empty
    b = behaviors.select(
        F.col("impression_id").cast("long").alias("impression_id"), F.col("user_id").cast("string").alias("user_id"), F.col("impression_time").cast("timestamp_ntz").alias("timestamp"),
        _strings("article_ids_inview").alias("candidates"), clicked.alias("clicked"),
    )
    joined = b.join(h, "user_id", "left").withColumn("history", F.coalesce("history", empty))
    return conform(recency_seconds(joined), IMPRESSION)


def nested_articles(articles: DataFrame) -> DataFrame:
    return conform(
        articles.select(
            F.col("article_id").cast("string").alias("article_id"), "title", F.col("subtitle").alias("abstract"), "body", F.col("category_str").alias("category"),
            F.coalesce(F.col("ner_clusters"), F.array().cast("array<string>")).alias("entities"), "published_time", *(c for c in ("total_inviews", "total_pageviews", "total_read_time") if c in articles.columns),
        ),
        ARTICLE,
    )


def engagement_records(history: DataFrame, block: str) -> DataFrame:
    """(user_id, block, read_times, scrolls, history): one block's engagement records."""
    return history.select(F.col("user_id").cast("string").alias("user_id"), F.lit(block).alias("block"), _strings("article_id_fixed").alias("history"), F.col("read_time_fixed").cast("array<double>").alias("read_times"), F.col("scroll_percentage_fixed").cast("array<double>").alias("scrolls"))


def load_nested(spark: SparkSession, root: str, blocks: tuple[str, ...] = ("train", "validation")) -> tuple[DataFrame, DataFrame]:
    parts = [nested_impressions(spark.read.parquet(f"{root}/{b}/behaviors.parquet"), spark.read.parquet(f"{root}/{b}/history.parquet")) for b in blocks]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole, nested_articles(spark.read.parquet(f"{root}/articles.parquet"))


def load_records(spark: SparkSession, root: str, blocks: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """``engagement_records`` of the blocks: the last is the test block's own, those before it are early."""
    parts = [engagement_records(spark.read.parquet(f"{root}/{b}/history.parquet"), "test" if b == blocks[-1] else "early") for b in blocks]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


_BEHAVIORS = "impression_id long, user_id string, time string, history string, impressions string"
_NEWS = "article_id string, category string, subcategory string, title string, abstract string, url string, title_entities string, abstract_entities string"


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated text without header; a quote is an ordinary character."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("escape", "").option("nullValue", "").csv(path)


def packed_impressions(behaviors: DataFrame) -> DataFrame:
    shown, clicked = packed_pairs(F.col("impressions"))
    return conform(behaviors.select("impression_id", "user_id", clock_12h(F.col("time")).alias("timestamp"), shown.alias("candidates"), clicked.alias("clicked"), tokens(F.col("history")).alias("history")), IMPRESSION)


def packed_articles(news: DataFrame) -> DataFrame:
    entities = union_keep_order(entity_labels(F.col("title_entities")), entity_labels(F.col("abstract_entities")))
    return conform(news.select("article_id", "title", "abstract", "category", entities.alias("entities")), ARTICLE)


def load_packed(spark: SparkSession, root: str, blocks: tuple[str, ...] = ("train", "dev")) -> tuple[DataFrame, DataFrame]:
    """Articles that several blocks have come from the earliest."""
    imps = [packed_impressions(read_tsv(spark, f"{root}/{b}/behaviors.tsv", _BEHAVIORS)) for b in blocks]
    whole = imps[0]
    for p in imps[1:]:
        whole = whole.unionByName(p)
    return whole, keep_first([packed_articles(read_tsv(spark, f"{root}/{b}/news.tsv", _NEWS)) for b in blocks], "article_id")


LOADERS: dict[str, Callable[..., tuple[DataFrame, DataFrame]]] = {"nested": load_nested, "packed": load_packed}
#: Logs that keep read times and scrolls.
RECORDS: dict[str, Callable[..., DataFrame]] = {"nested": load_records}
