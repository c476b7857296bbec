"""Exact dedup: 128-bit content hash, stable survivor, bytes compared inside groups.

The first pass keeps only (id, hash) a document.  The second reads again the
texts of hashes that occur twice or more, and compares their bytes as the
least and greatest text of each hash: equal if and only if the group holds one
text.  Both are aggregates with map-side combining; large groups are salted
besides, so no group meets whole in one task.  A hash with two texts (never
seen) is grouped by the texts themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import LONG_MIN, keep_rows, materialise

#: A hash group is large if it holds more than this share of all rows; there are at most as many
#: such groups as the share goes into one, so their list (40 bytes each) may be broadcast.
LARGE_SHARE = 1 / 20_000
#: Rows of a large group for each salt.
ROWS_A_SALT = 2_000


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row for each (doc_id, text) pair, checkpointed.

    Columns: doc_id, digest binary (128 bits), tail binary (the rest of the
    SHA-256), times long (rows with this id and text), keep_id, group_size.
    Null texts count as empty; null ids count as the smallest and stay null.
    """
    full = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    thin = rows.select("doc_id", full.alias("full")).select("doc_id", F.substring("full", 1, 16).alias("digest"), F.substring("full", 17, 16).alias("tail"))
    thin = materialise(thin.groupBy("doc_id", "digest", "tail").agg(F.count("*").alias("times")))
    survivor = F.max("doc_id") if keep == "max" else F.when(F.count("*") > F.count("doc_id"), F.lit(None)).otherwise(F.min("doc_id"))
    by_hash = materialise(thin.groupBy("digest").agg(survivor.alias("keep_id"), F.sum("times").alias("group_size")).filter("group_size > 1"))
    clash = _clashes(rows, by_hash)
    single = F.coalesce(F.col("group_size"), F.lit(1).cast("long"))
    out = thin.join(by_hash, "digest", "left").select("doc_id", "digest", "tail", "times", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), single.alias("group_size"))
    if clash.isEmpty():
        return out
    texts = rows.withColumn("full", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))).withColumn("digest", F.substring("full", 1, 16)).withColumn("tail", F.substring("full", 17, 16)).join(clash, "digest", "left_semi")
    per_id = texts.groupBy("digest", "tail", F.coalesce("text", F.lit("")).alias("text"), "doc_id").agg(F.count("*").alias("times"))
    per_text = per_id.groupBy("digest", "text").agg(survivor.alias("keep_id"), F.sum("times").alias("group_size"))
    split = per_id.join(per_text, ["digest", "text"]).select("doc_id", "digest", "tail", "times", "keep_id", "group_size")
    return out.join(clash, "digest", "left_anti").unionByName(split)


def _clashes(rows: DataFrame, by_hash: DataFrame) -> DataFrame:
    """Hashes of ``by_hash`` under which the texts of ``rows`` differ."""
    row = by_hash.agg(F.sum("group_size").alias("n")).first()
    large = by_hash.filter(F.col("group_size") > F.lit(max(100, int((row.n or 0) * LARGE_SHARE)))).select("digest", F.ceil(F.col("group_size") / ROWS_A_SALT).cast("int").alias("salts"))
    texts = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16))
    salted = texts.join(F.broadcast(large), "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(LONG_MIN))), F.col("salts")), F.lit(0)).cast("int"))
    wanted = by_hash.select("digest").join(F.broadcast(large), "digest", "left").select("digest", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    part = salted.join(wanted, ["digest", "salt"]).groupBy("digest", "salt").agg(F.min("text").alias("a"), F.max("text").alias("z"))
    whole = part.groupBy("digest").agg(F.min("a").alias("a"), F.max("z").alias("z"))
    return materialise(whole.filter("a <> z").select("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "max" or "min": which id of a group stays.  Of rows that repeat
    both id and text, one is kept.  Null texts equal empty ones.  An empty
    table gives an empty table; other columns are not read.
    """
    g = groups(docs, id_col, text_col, keep)
    turn = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("turn")
    return g.select("doc_id", "digest", "tail", "keep_id", "group_size", turn).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"), F.lower(F.hex(F.concat("digest", "tail"))).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs``, all columns, of which the first copy stays."""
    g = groups(docs, id_col, text_col, keep)
    return keep_rows(docs, g.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))), g.filter("times > 1"), id_col, text_col)
