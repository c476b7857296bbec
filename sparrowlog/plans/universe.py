"""Two click logs made of the driver's tables, in the normalised model.

L1 (events): an impression is a user's day; its candidates are the distinct
items of the day in order of first sight, clicked if any of the day's events
on them is a click or a purchase.  Articles are the documents, vectors the
embeddings of the same ids.
L2 (orders and lineitem): an impression is an order, candidates its lines'
parts, clicked if returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.columns import doubles, micros, unit
from ..shared import spread


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Typed events: imp, user_id, item, ts, us, click, read_time, scroll."""
    e = spread(spark.read.parquet(f"{sf}/events.parquet"), "event_id")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    return e.select(
        "event_id", "ts", micros(F.col("ts")).alias("us"), F.col("user_id").cast("string").alias("user_id"), F.get_json_object("props", "$.k").alias("item"),
        F.col("event_type").isin("click", "purchase").alias("click"), F.col("value").alias("read_time"), (F.col("event_id") % 101).cast("double").alias("scroll"),
        (F.col("user_id") * 100000 + day).cast("long").alias("imp"),
    )


def candidates(ev: DataFrame) -> DataFrame:
    """Candidate grain: imp, user_id, ts, us, pos (from 1), item, label."""
    seen = ev.groupBy("imp", "user_id", "item").agg(F.min("ts").alias("first"), F.max(F.col("click").cast("int")).alias("label"))
    w = Window.partitionBy("imp")
    t = F.min("first").over(w)
    return seen.select("imp", "user_id", t.alias("ts"), micros(t).alias("us"), F.row_number().over(w.orderBy("first", "item")).alias("pos"), "item", "label")


def impressions(ev: DataFrame) -> DataFrame:
    """Nested impressions, each with the user's clicks strictly before it as history.

    A user's clicks are listed once and cut at each impression's time, as the
    nested log has them: one row a user, not one an impression and click.
    """
    c = candidates(ev).groupBy("imp", "user_id", "ts", "us").agg(F.array_sort(F.collect_list(F.struct("pos", "item", "label"))).alias("c"))
    x = F.struct("us", "event_id", "ts", "item", "read_time", "scroll")
    clicks = ev.filter("click").groupBy("user_id").agg(F.array_sort(F.collect_list(x)).alias("all"))
    joined = c.join(clicks, "user_id", "left").withColumn("h", F.filter("all", lambda x: x.us < F.col("us")))
    h = F.when(F.size("h") > 0, F.col("h"))
    return joined.withColumn("h", h).select(
        F.col("imp").alias("impression_id"), "user_id", F.col("ts").alias("timestamp"), F.transform("c", lambda x: x.item).alias("candidates"), F.transform(F.filter("c", lambda x: x.label == 1), lambda x: x.item).alias("clicked"),
        F.coalesce(F.transform("h", lambda x: x["item"]), F.array().cast("array<string>")).alias("history"), F.transform("h", lambda x: x.ts).alias("history_timestamps"),
        F.transform("h", lambda x: x.read_time).alias("read_times"), F.transform("h", lambda x: x.scroll).alias("scrolls"),
    )


def history(imps: DataFrame) -> DataFrame:
    """History grain: imp, h (from 1, oldest first), item, read_time, scroll, hist_len."""
    z = F.arrays_zip(F.col("history").alias("item"), F.col("read_times").alias("read_time"), F.col("scrolls").alias("scroll"))
    return imps.select(F.col("impression_id").alias("imp"), F.size("history").alias("hist_len"), F.posexplode(z).alias("at", "x")).select("imp", (F.col("at") + 1).alias("h"), "x.item", "x.read_time", "x.scroll", "hist_len")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of L1: title (the first sentence), body, category, entities (the words over 12 letters), published_time."""
    d = spread(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    return d.select(
        F.col("doc_id").cast("string").alias("article_id"), F.regexp_extract("text", r"^[^.\n]*", 0).alias("title"), F.col("text").alias("body"), F.col("source").alias("category"),
        F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.char_length(w) > 12)).alias("entities"),
        F.when(F.col("doc_id") % 7 != 0, F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * F.lit(21600000000)).cast("timestamp_ntz")).alias("published_time"),
        F.col("n_chars").cast("int").alias("total_inviews"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(item, v): unit vectors in double."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select(F.col("vec_id").cast("string").alias("item"), unit(doubles(F.col("embedding"))).alias("v"))


def order_log(spark: SparkSession, sf: str) -> DataFrame:
    """L2 at candidate grain: imp, user_id, ts, us, pos, item, label."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderdate").alias("ts"))
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    tie = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*tie))
    lines = l.select("l_orderkey", pos.alias("pos"), F.col("l_partkey").cast("string").alias("item"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_extendedprice").alias("price"))
    return o.join(lines, o.o_orderkey == lines.l_orderkey).select(F.col("o_orderkey").alias("imp"), "user_id", "ts", micros(F.col("ts")).alias("us"), "pos", "item", "label", "price")
