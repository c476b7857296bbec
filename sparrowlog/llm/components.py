"""Connected components of a link table, by alternating star contraction.

Each round hangs every larger neighbour on the smallest one it sees (large
star), then every smaller neighbour (small star), until all links are stars.
The minima are aggregates with map-side combining and the joins may be split
by skew, so a node with very many links does not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise


#: Links a partition holds, about, and links (16 bytes each) up to which a round's minima are broadcast to them.
PART_LINKS, BROADCAST_LINKS = 100_000, 400_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node in ``links`` (u long, v long); root is the least node reachable.

    Self links and repeats do no harm; an empty table gives an empty table.
    Links are kept in as many partitions as their number asks for, whatever
    the number of shuffle partitions.
    """
    e = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = materialise(e)
    seen = _state(e)
    e = e.coalesce(_parts(seen[0]))
    while seen[0]:
        small_enough = seen[0] <= BROADCAST_LINKS
        side = F.broadcast if small_enough else lambda x: x
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(side(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large.coalesce(_parts(2 * seen[0])))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(side(least), "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(_parts(2 * seen[0])))
        now = _state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _parts(rows: int) -> int:
    return max(1, -(-rows // PART_LINKS))


def _state(e: DataFrame) -> tuple[int, int | None]:
    row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x
