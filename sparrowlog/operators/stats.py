"""Bootstrap confidence intervals.

``exact`` replays resampling with NumPy's generator on the ordered vector of
one system: the values of one metric of one system must fit in a task.
``poisson`` scales: each row draws a Poisson(1) weight for each replicate from
a hash of its key, so weights are equal for both arms of a pair, need no
shuffle of rows and sum with map-side combining.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

RESAMPLES, CHUNK, SEED = 1000, 50, 0


def bootstrap_means(values: np.ndarray, resamples: int = RESAMPLES, seed: int = SEED) -> np.ndarray:
    """Means of resamples, drawn CHUNK at a time to bound memory."""
    rng = np.random.default_rng(seed)
    out = []
    for at in range(0, resamples, CHUNK):
        rows = min(CHUNK, resamples - at)
        out.append(values[rng.integers(0, len(values), size=(rows, len(values)))].mean(axis=1))
    return np.concatenate(out)


def exact_interval(rows: DataFrame, value: str, order: str, *by: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(by, mean, lo, hi, n): percentile interval of the mean, per group ordered by a key."""
    schema = ", ".join([*(f"{c} {t}" for c, t in rows.select(*by).dtypes), "mean double", "lo double", "hi double", "n long"])

    def f(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        v = part.sort_values(order)[value].to_numpy(float)
        means = bootstrap_means(v, resamples, seed)
        return pd.DataFrame([[*key, v.mean(), *np.percentile(means, [2.5, 97.5]), len(v)]])

    return rows.select(*by, order, value).groupBy(*by).applyInPandas(f, schema)


#: Cumulated chances of a Poisson(1) draw of 0, 1, 2, ...
_POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1), initial=1.0) for k in range(9)]).tolist()


def _uniform(key: Column, replicate: Column) -> Column:
    return F.pmod(F.xxhash64(key, replicate), F.lit(1 << 30)) / F.lit(float(1 << 30))


def poisson_weight(key: Column, replicate: Column) -> Column:
    u = _uniform(key, replicate)
    return sum(((u >= p).cast("int") for p in _POISSON), F.lit(0))


def poisson_interval(rows: DataFrame, value: str, key: str, *by: str, resamples: int = 200) -> DataFrame:
    """(by, mean, lo, hi, n) by Poisson weights; also paired, if ``value`` is a difference."""
    replicates = rows.select(*by, F.col(key).alias("k"), F.col(value).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    w = poisson_weight(F.col("k"), F.col("r"))
    means = replicates.groupBy(*by, "r").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("m"))
    spread = means.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    plain = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    joined = plain.join(spread, list(by)) if by else plain.crossJoin(spread)  # one row each
    return joined.select(*by, "mean", "lo", "hi", "n").withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


#: Replicates whose bits share one long.
_BITS = 50


def coverage_spread(top: DataFrame, catalogue_size: int, list_key: str = "imp", item: str = "item", resamples: int = 100) -> DataFrame:
    """How coverage moves when lists are resampled (no confidence interval: distinct counts only fall).

    A list's replicates are the bits of a few longs, or-ed by item: one row an
    item, and not one a list and replicate.
    """
    groups = [range(at, min(at + _BITS, resamples)) for at in range(0, resamples, _BITS)]

    def mask(g: range) -> Column:
        """Bit r - g.start for each replicate r that draws the list at all."""
        drawn = lambda r: _uniform(F.col(list_key), r) >= _POISSON[0]
        bit = lambda r: F.call_function("shiftleft", F.lit(1).cast("long"), r - F.lit(g.start))
        return F.aggregate(F.sequence(F.lit(g.start), F.lit(g.stop - 1)), F.lit(0).cast("long"), lambda acc, r: F.when(drawn(r), acc.bitwiseOR(bit(r))).otherwise(acc))

    bits = [mask(g) for g in groups]
    held = top.select(item, *(b.alias(f"b{k}") for k, b in enumerate(bits))).groupBy(item).agg(*(F.bit_or(f"b{k}").alias(f"b{k}") for k in range(len(groups))))
    counts = held.agg(*(F.sum(F.shiftright(f"b{k}", i).bitwiseAND(F.lit(1).cast("long"))).alias(f"r{r}") for k, g in enumerate(groups) for i, r in enumerate(g)))
    c = counts.select(F.explode(F.array(*(F.coalesce(f"r{r}", F.lit(0)) / F.lit(float(catalogue_size)) for r in range(resamples)))).alias("c"))
    return c.agg(F.avg("c").alias("mean"), F.percentile("c", F.lit(0.025)).alias("lo"), F.percentile("c", F.lit(0.975)).alias("hi"), F.count("*").alias("resamples"))
