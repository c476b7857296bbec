"""Point-in-time counts: how many events of a key lie in [t - w, t).

A count in a window is the difference of two counts of all that came before.
Those are taken in two levels so that a key with very many events isn't one
task's work: keys are cut into time buckets, running counts are made within
(key, bucket), and the buckets' totals, few rows a key, are summed before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOUR = 3_600_000_000
BUCKET = 24 * HOUR
#: Hours or None, or such with the name of a weight.
Window_ = float | None | tuple[float | None, str]


def causal_counts(probes: DataFrame, events: DataFrame, key: str, windows: dict[str, Window_], weights: dict[str, Column] | None = None, probe_us: str = "us", event_us: str = "us", bucket: int = BUCKET) -> DataFrame:
    """``probes`` with one long column for each window: name -> hours, or None for all the past.

    Strictly before the probe; the lower bound is inclusive.  Probes with a
    null key or time count 0.  Probe rows may repeat.  With ``weights`` (name
    -> what each event counts for) a window may be (hours, weight): several
    kinds of events are then counted in the same pass.
    """
    weights = weights or {"n": F.lit(1)}
    first = next(iter(weights))
    asked_for = {name: w if isinstance(w, tuple) else (w, first) for name, w in windows.items()}
    bounds = {None: 0} | {h: round(h * HOUR) for h, _ in asked_for.values() if h is not None}
    points = F.explode(F.array_distinct(F.array(*(F.col(probe_us) - F.lit(w) for w in bounds.values()))))
    asked = probes.select(F.col(key).alias("k"), points.alias("x")).filter("k is not null and x is not null").distinct()
    happened = events.select(F.col(key).alias("k"), F.col(event_us).alias("x"), *(w.cast("long").alias(f"w_{n}") for n, w in weights.items())).filter("k is not null and x is not null")
    happened = happened.groupBy("k", "x").agg(*(F.sum(f"w_{n}").alias(f"w_{n}") for n in weights))
    both = asked.select("k", "x", *(F.lit(0).cast("long").alias(f"w_{n}") for n in weights), F.lit(True).alias("probe")).unionByName(happened.withColumn("probe", F.lit(False)))
    both = both.withColumn("b", F.floor(F.col("x") / F.lit(bucket)).cast("long"))
    earlier = Window.partitionBy("k", "b").orderBy("x").rangeBetween(Window.unboundedPreceding, -1)
    inside = both.withColumns({f"in_{n}": F.coalesce(F.sum(f"w_{n}").over(earlier), F.lit(0)) for n in weights}).filter("probe").select("k", "b", "x", *(f"in_{n}" for n in weights))
    totals = both.groupBy("k", "b").agg(*(F.sum(f"w_{n}").alias(f"w_{n}") for n in weights))
    whole = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("k", "b", *(F.coalesce(F.sum(f"w_{n}").over(whole), F.lit(0)).alias(f"be_{n}") for n in weights))
    counted = inside.join(before, ["k", "b"]).select("k", "x", *((F.col(f"in_{n}") + F.col(f"be_{n}")).alias(n) for n in weights))
    # One row for each (key, time) asked, with the counts at all its bounds, so the probes are joined once.
    times = probes.select(F.col(key).alias("k"), F.col(probe_us).alias("t")).filter("k is not null and t is not null").distinct()
    spread = times.select("k", "t", F.posexplode(F.array(*(F.col("t") - F.lit(w) for w in bounds.values()))).alias("i", "x"))
    place = {h: i for i, h in enumerate(bounds)}
    found = spread.join(counted, ["k", "x"]).groupBy("k", "t").agg(*(F.max(F.when(F.col("i") == i, F.col(n))).alias(f"c_{n}_{i}") for i in place.values() for n in weights))
    out = probes.join(found, (F.col(key) == F.col("k")) & (F.col(probe_us) == F.col("t")), "left")
    count = lambda h, n: F.coalesce(F.col(f"c_{n}_0"), F.lit(0)) - (F.lit(0) if h is None else F.coalesce(F.col(f"c_{n}_{place[h]}"), F.lit(0)))
    return out.select(*probes.columns, *(count(h, n).cast("long").alias(name) for name, (h, n) in asked_for.items()))


def latest_before(probes: DataFrame, events: DataFrame, key: str, probe_us: str = "us", event_us: str = "us", bucket: int = BUCKET) -> DataFrame:
    """``probes`` with last_us: the latest event of the key strictly before, null if none.

    As in ``causal_counts``: within (key, bucket), or else the latest of the key's buckets before.
    """
    asked = probes.select(F.col(key).alias("k"), F.col(probe_us).alias("x")).distinct().withColumn("e", F.lit(None).cast("long"))
    rows = asked.unionByName(events.select(F.col(key).alias("k"), F.col(event_us).alias("x"), F.col(event_us).alias("e")).distinct())
    rows = rows.withColumn("b", F.floor(F.col("x") / F.lit(bucket)).cast("long"))
    inside = rows.withColumn("near", F.max("e").over(Window.partitionBy("k", "b").orderBy("x").rangeBetween(Window.unboundedPreceding, -1))).filter("e is null").select("k", "b", F.col("x").alias("__x"), "near")
    whole = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("k", "b").agg(F.max("e").alias("e")).select("k", "b", F.max("e").over(whole).alias("far"))
    found = inside.join(before, ["k", "b"]).select("k", "__x", F.coalesce("near", "far").alias("last_us"))
    return probes.join(found, (F.col(key) == F.col("k")) & (F.col(probe_us) == F.col("__x")), "left").select(*probes.columns, "last_us")
