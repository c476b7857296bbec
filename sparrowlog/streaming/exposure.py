"""Streaming forms of the exposure counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def hourly_exposures(stream: DataFrame, late: str = "2 hours", width: str = "6 hours", step: str | None = None, ts: str = "ts", item: str = "item") -> DataFrame:
    """(item, start, n) in tumbling or sliding windows, with a watermark for late events; works on batches too."""
    timed = stream.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    w = F.window("__t", width, step) if step else F.window("__t", width)
    return timed.groupBy(w.alias("w"), item).agg(F.count("*").alias("n")).select(item, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(stream: DataFrame, late: str = "2 hours", gap: str = "30 minutes", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """(user, start, stop, n): events of a user no farther apart than the gap."""
    timed = stream.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    w = F.session_window("__t", gap)
    return timed.groupBy(w.alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")


def run_to_end(frame: DataFrame, where: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its table, which it writes as Parquet under ``where``; for tests and replays.

    In complete mode each batch is the whole table so far, and the last one counts.
    """
    spark, done = frame.sparkSession, []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/batch={number}")
        done.append(f"{where}/batch={number}")

    frame.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{where}-state").trigger(availableNow=True).start().awaitTermination()
    read = spark.read.schema(frame.schema)
    return read.parquet(*(done[-1:] if mode == "complete" else done)) if done else spark.createDataFrame([], frame.schema)
