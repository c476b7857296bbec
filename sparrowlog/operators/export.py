"""Ranked lists as text, packed as a zip of one member, and their validation."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from ..functions.windows import ordinal_rank


def rank_lists(scored: DataFrame, by: str = "imp", score: str = "score", pos: str = "pos") -> DataFrame:
    """(by, ranks): the place of each candidate, in the order of the candidates."""
    ranked = scored.select(by, pos, ordinal_rank(F.col(score), F.col(pos), by).alias("r"))
    return ranked.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, "r"))), lambda x: x.r).alias("ranks"))


def lines(ranked: DataFrame, by: str = "imp") -> DataFrame:
    """(by, line): "<id> [r1,...,rn]"."""
    return ranked.select(by, F.format_string("%s [%s]", F.col(by).cast("string"), F.array_join(F.col("ranks").cast("array<string>"), ",")).alias("line"))


def write_lines(ranked: DataFrame, path: str, by: str = "imp", files: int = 1) -> None:
    """Text files in order of id."""
    lines(ranked, by).repartitionByRange(files, by).sortWithinPartitions(by).select("line").write.mode("overwrite").text(path)


def pack(parts: str, out: str, member: str = "prediction.txt", smoke: bool = False) -> str:
    """Zips local part files into one member; a smoke run goes to a name of its own."""
    target = Path(out).with_suffix(".smoke.zip" if smoke else ".zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z, z.open(member, "w") as to:
        for p in sorted(Path(parts).glob("part-*")):
            to.write(p.read_bytes())
    return str(target)


def unpack(path: str) -> list[str]:
    """Lines of a zip's only member."""
    with zipfile.ZipFile(path) as z:
        if len(names := z.namelist()) != 1:
            raise ValueError(f"{len(names)} members, not one")
        return z.read(names[0]).decode().splitlines()


def parse(text: DataFrame, line: str = "line") -> DataFrame:
    """(id, ranks) of lines."""
    ranks = F.transform(F.split(F.regexp_extract(line, r"\[(.*)\]", 1), ","), lambda x: x.try_cast("int"))
    return text.select(F.regexp_extract(line, r"^(\S+) ", 1).alias("id"), ranks.alias("ranks"))


def validate(submitted: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: rows expected and found, rows out of order or absent, rows whose ranks aren't 1..n once each.

    ``submitted``: row, id, ranks.  ``expected``: row, id, n.
    """
    both = expected.join(submitted.select("row", F.col("id").alias("got"), "ranks"), "row", "full_outer")
    size = F.coalesce(F.size("ranks"), F.lit(0))
    whole = F.when(F.col("n") > 0, F.coalesce(F.array_sort("ranks") == F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(False))).otherwise(size == 0)
    return both.agg(
        F.count("n").alias("expected"), F.count("got").alias("found"), F.count(F.when(~F.col("id").eqNullSafe(F.col("got")), 1)).alias("out_of_order"),
        F.count(F.when(F.col("ranks").isNotNull() & F.col("n").isNotNull() & (size != F.col("n")), 1)).alias("wrong_length"), F.count(F.when(F.col("n").isNotNull() & F.col("ranks").isNotNull() & (size == F.col("n")) & ~whole, 1)).alias("bad_permutation"),
    )
