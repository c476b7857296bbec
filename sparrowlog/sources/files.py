"""Readers and writers of the files between stages."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import doubles, unit
from ..operators.splits import require_covered


def write_sorted(df: DataFrame, path: str, *by: str, files: int | None = None) -> None:
    """Parquet in ranges of the keys, sorted within each file, so readers can skip row groups."""
    ranged = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def export_text(articles: DataFrame, path: str, fields: tuple[str, ...] = ("title", "abstract", "body")) -> DataFrame:
    """zstd Parquet of (article_id, text); returns (rows, mean, median, p95) of the lengths in characters."""
    used = [F.coalesce(F.col(f), F.lit("")) for f in fields if f in articles.columns]
    text = articles.select("article_id", F.concat_ws(" ", *used).alias("text"))
    text.write.mode("overwrite").option("compression", "zstd").parquet(path)
    n = F.char_length("text")
    return articles.sparkSession.read.parquet(path).agg(F.count("*").alias("rows"), F.avg(n).alias("mean"), F.median(n).alias("median"), F.percentile(n, F.lit(0.95)).alias("p95"))


def read_vectors(spark: SparkSession, path: str, wanted: DataFrame | None = None, key: str = "article_id") -> DataFrame:
    """(item, v): unit vectors; the vector is the one column that isn't the id, whatever its name.

    With ``wanted`` ids only theirs, and an error if one has none.
    """
    df = spark.read.parquet(path)
    (vector,) = [c for c in df.columns if c != key]
    df = df.select(F.col(key).cast("string").alias(key), F.col(vector).alias("v"))
    df = require_covered(wanted.select(F.col(key).cast("string").alias(key)), df, key) if wanted is not None else df
    return df.select(F.col(key).alias("item"), unit(doubles(F.col("v"))).alias("v"))


def encoded(df: DataFrame, dictionary: DataFrame, column: str, key: str = "article_id", row: str = "row", unknown: int = -1) -> DataFrame:
    """``df`` with an id column replaced by its row in a dictionary; ids it lacks become ``unknown``."""
    d = dictionary.select(F.col(key).alias(column), F.col(row).alias("__row"))
    return df.join(d, column, "left").withColumn(column, F.coalesce("__row", F.lit(unknown))).drop("__row")


def write_report(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(report, indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8")


def markdown_table(rows: list[dict], columns: list[str] | None = None, digits: int = 4) -> str:
    """A small collected frame as a Markdown table."""
    columns = columns or list(rows[0]) if rows else columns or []
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]) + "\n"


def latex_macros(values: dict[str, object], digits: int = 4) -> str:
    """One \\newcommand a value; names keep only letters, and values that aren't there yet say so."""
    out = []
    for name, v in sorted(values.items()):
        text = "pending" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
        out.append(f"\\newcommand{{\\{re.sub('[^A-Za-z]', '', name.title())}}}{{{text}}}")
    return "\n".join(out) + "\n"


def latex_table(rows: list[dict], columns: list[str], digits: int = 4) -> str:
    cell = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    body = [" & ".join(cell(r.get(c)) for c in columns) + r" \\" for r in rows]
    return "\n".join([rf"\begin{{tabular}}{{l{'r' * (len(columns) - 1)}}}", " & ".join(c.replace("_", r"\_") for c in columns) + r" \\ \hline", *body, r"\end{tabular}"]) + "\n"


#: Patterns of what must not leave the machine in a transcript, and what stands in their place.
REDACTED = ((r"[\w.+-]+@[\w-]+\.[\w.]+", "<email>"), (r"(?:/home|/Users)/[^/\s\"']+", "<home>"), (r"\b(?:ghp|sk|hf)_[A-Za-z0-9]{16,}\b", "<token>"), (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>"))


def read_transcript(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSON lines with every string field redacted, and cut to ``limit`` characters if asked."""
    df = spark.read.json(path)

    def clean(name: str):
        c = F.col(f"`{name}`")
        for pattern, to in REDACTED:
            c = F.regexp_replace(c, pattern, to)
        return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c) if limit else c

    return df.select(*(clean(n).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes))
