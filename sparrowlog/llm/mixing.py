"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Token counts are summed over cells of source, language and topic.  Raking
scales the cells in turn to each marginal's targets until all hold.  Without
``repeat`` a cell's probability is at most 1, so a value can't have more of the
sample than it has tokens: such targets are cut to what is reachable, the
others take up the difference in proportion, and raking runs under the bound:
cells at 1 stay there while the others are scaled.  With ``repeat`` nothing is
cut: a probability over 1 is so many whole copies, and one more by the
fraction.  ``marginals`` gives targets, what of them is reachable, and what is
expected and taken.  A document is taken if a hash of its id and text lies
under its probability, so the sample doesn't depend on partitioning and can be
made again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import LONG_MIN, fresh, materialise

#: Cells up to which raking runs on the driver (under 100 bytes each); beyond, the same steps run as DataFrame joins.
DRIVER_CELLS = 200_000
ROUNDS, TOLERANCE = 200, 1e-9
#: Rounds of raking under the bound, and the decimals of probabilities: either way of raking gives the same ones.
BOUND_ROUNDS, BOUND_TOLERANCE, DECIMALS = 200, 1e-7, 7
AXES = ("source", "language", "topic")
NONE = "(none)"


@dataclass(frozen=True)
class Targets:
    """Wanted shares by value of each axis.

    Values not named share what is left in proportion to the power ``temper``
    of their tokens (1: as they are, 0: equally).  Named values that no
    document has don't count.
    """

    source: dict[str, float] = field(default_factory=dict)
    language: dict[str, float] = field(default_factory=dict)
    topic: dict[str, float] = field(default_factory=dict)
    temper: float = 0.5
    share: float = 0.6
    repeat: bool = False
    seed: int = 42


def token_count(text: Column) -> Column:
    """Words between white space; at least 1, so that no document is without weight."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")), F.lit(1)).cast("long")


def topic_of(text: Column) -> Column:
    """What kind of page a text is, by marks in it: the first of these that fits."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains(" | "), "table")
        .when(t.contains("Licensed under") | t.contains("All rights reserved"), "licence")
        .when(t.contains("http://") | t.contains("https://") | t.contains("@"), "contact")
        .when(F.length(t) < 400, "snippet")
        .otherwise("prose")
    )


def _target_table(mass: dict, named: dict[str, float], temper: float) -> dict:
    given = {k: v for k, v in named.items() if k in mass}
    rest = {k: m**temper for k, m in mass.items() if k not in given}
    left = max(0.0, 1.0 - sum(named.values())) if rest else 0.0
    if rest and left == 0.0:
        left = min(rest.values()) / sum(m**temper for m in mass.values())
    total = sum(rest.values()) or 1.0
    out = given | {k: left * v / total for k, v in rest.items()}
    whole = sum(out.values())
    return {k: v / whole for k, v in out.items()}


def rake(cells: pd.DataFrame, targets: Targets) -> np.ndarray:
    """Raked share of each cell; ``cells`` has the axes and ``tokens``."""
    if not len(cells):
        return np.zeros(0)
    share = cells.tokens.to_numpy(float) / cells.tokens.sum()
    codes, wanted = [], []
    for axis in AXES:
        code, values = pd.factorize(cells[axis], sort=True)
        mass = dict(zip(values, np.bincount(code, share)))
        table = _target_table(mass, getattr(targets, axis), targets.temper)
        codes.append(code)
        wanted.append(np.array([table[v] for v in values]))
    for _ in range(ROUNDS):
        off = 0.0
        for code, want in zip(codes, wanted):
            now = np.bincount(code, share, len(want))
            off = max(off, np.abs(now - want).max())
            share = share * (want / now)[code]
        if off < TOLERANCE:
            break
    return share


def reachable(mass: np.ndarray, want: np.ndarray, goal: float) -> np.ndarray:
    """What each value can have of ``goal`` in all, wanted in the proportions ``want``, if it has no more than its ``mass``."""
    by, cut = 1.0, np.zeros(len(mass), bool)
    while True:
        now = by * want * goal >= mass
        if now.all() or (now == cut).all() and by != 1.0 or not now.any():
            return np.where(now, mass, by * want * goal)
        cut = now
        by = max(by, (goal - mass[cut].sum()) / max(want[~cut].sum() * goal, 1e-300))


def bounded(cells: pd.DataFrame, targets: Targets) -> np.ndarray:
    """Each cell's probability: raked to the reachable targets, none over 1."""
    if not len(cells):
        return np.zeros(0)
    tokens = cells.tokens.to_numpy(float)
    goal = targets.share * tokens.sum()
    codes, aims = [], []
    for axis in AXES:
        code, values = pd.factorize(cells[axis], sort=True)
        mass = np.bincount(code, tokens)
        table = _target_table(dict(zip(values, mass / tokens.sum())), getattr(targets, axis), targets.temper)
        codes.append(code)
        aims.append(reachable(mass, np.array([table[v] for v in values]), goal))
    p = np.full(len(tokens), float(targets.share))
    for _ in range(BOUND_ROUNDS):
        off = 0.0
        for code, aim in zip(codes, aims):
            full = p >= 1
            m, held = np.bincount(code, tokens * p, len(aim)), np.bincount(code, tokens * full, len(aim))
            off = max(off, np.abs(m - aim).max() / goal)
            up, down = (aim - held) / np.maximum(m - held, 1e-300), aim / m
            p = np.minimum(1.0, np.where((m > aim)[code], p * down[code], np.where(full, 1.0, p * up[code])))
        if off < BOUND_TOLERANCE:
            break
    for _ in range(BOUND_ROUNDS):  # targets that contradict one another leave the whole a little off
        m, held = (tokens * p).sum(), tokens[p >= 1].sum()
        if abs(m - goal) <= 1e-12 * goal or m == held:
            break
        p = np.minimum(1.0, p * (goal / m)) if m > goal else np.where(p >= 1, 1.0, np.minimum(1.0, p * ((goal - held) / (m - held))))
    return p


def _wanted(cells: DataFrame, targets: Targets, axis: str) -> DataFrame:
    """(axis, m, want): ``_target_table`` as DataFrame; m is the value's share of tokens."""
    total = cells.agg(F.sum("tokens")).first()[0]
    mass = cells.groupBy(axis).agg((F.sum("tokens") / F.lit(float(total or 1))).alias("m"))
    named = getattr(targets, axis)
    keys = F.create_map(*[F.lit(x) for kv in named.items() for x in kv]) if named else F.create_map().cast("map<string,double>")
    mass = mass.withColumn("given", F.try_element_at(keys, F.col(axis)).cast("double")).withColumn("soft", F.when(F.col("given").isNull(), F.pow("m", F.lit(targets.temper))))
    sums = mass.agg(F.sum("soft").alias("rest"), F.min("soft").alias("least"), F.sum(F.pow("m", F.lit(targets.temper))).alias("every")).first()
    left = max(0.0, 1.0 - sum(named.values())) if sums.rest else 0.0
    if sums.rest and left == 0.0:
        left = sums.least / sums.every
    table = mass.select(axis, "m", F.coalesce("given", F.lit(left) * F.col("soft") / F.lit(sums.rest or 1.0)).alias("want"))
    whole = table.agg(F.sum("want")).first()[0]
    return materialise(table.withColumn("want", F.col("want") / F.lit(whole or 1.0)))


def rake_cells(cells: DataFrame, targets: Targets) -> DataFrame:
    """``rake`` as DataFrame joins: ``cells`` with a column ``raked``."""
    total = cells.agg(F.sum("tokens")).first()[0]
    now = cells.withColumn("raked", F.col("tokens") / F.lit(float(total or 1)))
    wanted = {axis: _wanted(cells, targets, axis) for axis in AXES}
    for _ in range(ROUNDS):
        off = 0.0
        for axis in AXES:
            scale = now.groupBy(axis).agg(F.sum("raked").alias("is")).join(wanted[axis], axis).select(axis, (F.col("want") / F.col("is")).alias("by"), F.abs(F.col("want") - F.col("is")).alias("off"))
            scale = materialise(scale)
            off = max(off, scale.agg(F.max("off")).first()[0] or 0.0)
            now = now.join(scale.select(axis, "by"), axis).withColumn("raked", F.col("raked") * F.col("by")).drop("by")
        now = materialise(now)
        if off < TOLERANCE:
            break
    return now


def _reachable_cells(table: DataFrame, axis: str, goal: float, total: float) -> DataFrame:
    """(axis, aim): ``reachable`` as DataFrame."""
    mass, want, by, cut = F.col("m") * F.lit(total), F.col("want") * F.lit(goal), 1.0, -1
    while True:
        full = F.lit(by) * want >= mass
        row = table.agg(F.sum(full.cast("long")).alias("n"), F.coalesce(F.sum(F.when(full, mass)), F.lit(0.0)).alias("held"), F.coalesce(F.sum(F.when(~full, want)), F.lit(0.0)).alias("free")).first()
        if not row.free or row.n in (cut, 0):
            return materialise(table.select(axis, F.when(full, mass).otherwise(F.lit(by) * want).alias("aim")))
        cut, by = row.n, max(by, (goal - row.held) / row.free)


def bounded_cells(cells: DataFrame, targets: Targets) -> DataFrame:
    """``bounded`` as DataFrame joins: ``cells`` with a column ``p``."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    goal = targets.share * total
    aims = {axis: _reachable_cells(_wanted(cells, targets, axis), axis, goal, total) for axis in AXES}
    now = cells.withColumn("p", F.lit(float(targets.share)))
    for _ in range(BOUND_ROUNDS):
        off = 0.0
        for axis in AXES:
            m, held = F.sum(F.col("tokens") * F.col("p")), F.sum(F.col("tokens") * (F.col("p") >= 1).cast("int"))
            scale = materialise(now.groupBy(axis).agg(m.alias("m"), held.cast("double").alias("held")).join(aims[axis], axis))
            off = max(off, scale.agg(F.max(F.abs(F.col("m") - F.col("aim")))).first()[0] / goal)
            up, down = (F.col("aim") - F.col("held")) / F.greatest(F.col("m") - F.col("held"), F.lit(1e-300)), F.col("aim") / F.col("m")
            scaled = F.when(F.col("m") > F.col("aim"), F.col("p") * down).when(F.col("p") >= 1, F.lit(1.0)).otherwise(F.col("p") * up)
            now = now.join(scale, axis).withColumn("p", F.least(F.lit(1.0), scaled)).drop("m", "held", "aim")
        now = materialise(now)
        if off < BOUND_TOLERANCE:
            break
    for _ in range(BOUND_ROUNDS):
        row = now.agg(F.sum(F.col("tokens") * F.col("p")).alias("m"), F.sum(F.col("tokens") * (F.col("p") >= 1).cast("int")).cast("double").alias("held")).first()
        if abs(row.m - goal) <= 1e-12 * goal or row.m == row.held:
            break
        by = F.lit(goal / row.m) if row.m > goal else F.when(F.col("p") >= 1, F.lit(1.0)).otherwise(F.lit((goal - row.held) / (row.m - row.held)))
        now = materialise(now.withColumn("p", F.least(F.lit(1.0), F.col("p") * by)))
    return now


def _labelled(docs: DataFrame, names: list[str], source: Column, language: Column, text: Column) -> DataFrame:
    none = F.lit(NONE)
    return docs.withColumns(dict(zip(names, [F.coalesce(source.cast("string"), none), F.coalesce(language.cast("string"), none), topic_of(text), token_count(text)])))


def cell_table(docs: DataFrame, targets: Targets, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Cells with tokens, documents, weight and probability; with ``repeat`` the probability is the copies of a document to expect.

    weight: the cell's share of the tokens to expect over its share of all.
    """
    labelled = _labelled(docs.select(F.col(text_col).alias("t"), F.col(source_col).alias("s"), F.col(lang_col).alias("l")), [*AXES, "tokens"], F.col("s"), F.col("l"), F.col("t"))
    cells = materialise(labelled.groupBy(*AXES).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")))
    n, share = cells.count(), float(targets.share)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    if n <= DRIVER_CELLS:
        local = cells.toPandas().sort_values(list(AXES), ignore_index=True)
        local["p"] = share * total * rake(local, targets) / local.tokens.to_numpy(float) if targets.repeat else bounded(local, targets)
        spark = docs.sparkSession
        schema = "source string, language string, topic string, tokens long, documents long, p double"
        cells = spark.createDataFrame(local.astype({"tokens": int, "documents": int}).to_dict("records"), schema) if n else spark.createDataFrame([], schema)
    elif targets.repeat:
        cells = materialise(rake_cells(cells, targets)).withColumn("p", F.lit(share * total) * F.col("raked") / F.col("tokens")).drop("raked")
    else:
        cells = bounded_cells(cells, targets)
    probability = F.round("p", DECIMALS)
    return cells.withColumn("weight", probability / F.lit(share)).withColumn("probability", probability).drop("p")


def chance(id_col: Column, text: Column, seed: int) -> Column:
    """A number from 0 to 1 by hash of id and text."""
    h = F.xxhash64(F.coalesce(id_col.cast("long"), F.lit(LONG_MIN)), F.coalesce(text.cast("string"), F.lit("")), F.lit(seed))
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def copies(expected: Column, u: Column) -> Column:
    """Whole copies of a document, and one more if its number ``u`` lies under the fraction."""
    return (F.floor(expected) + (u < expected - F.floor(expected)).cast("long")).cast("int")


def marginals(plan: DataFrame, targets: Targets) -> DataFrame:
    """(axis, value, natural, target, reachable, expected, achieved): shares of tokens.

    natural: in all documents; target: wanted; reachable: the most of it that
    each axis by itself allows; expected: by the probabilities; achieved: taken.
    """
    cells = materialise(plan.groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("expected"), F.sum(F.col("n_tokens") * F.col("copies")).alias("achieved")))
    whole = cells.agg(F.sum("tokens").alias("tokens"), F.sum("expected").alias("expected"), F.sum("achieved").alias("achieved")).first()
    out = None
    for axis in AXES:
        want = _wanted(cells, targets, axis)
        goal = targets.share * float(whole.tokens or 1)
        aim = want.select(axis, F.col("want") * F.lit(goal)).toDF(axis, "aim") if targets.repeat else _reachable_cells(want, axis, goal, float(whole.tokens or 1))
        sums = cells.groupBy(axis).agg(F.sum("expected").alias("e"), F.sum("achieved").alias("t"))
        part = want.join(aim, axis).join(sums, axis).select(
            F.lit(axis).alias("axis"), F.col(axis).alias("value"), F.col("m").alias("natural"), F.col("want").alias("target"), (F.col("aim") / F.lit(goal)).alias("reachable"),
            (F.col("e") / F.lit(float(whole.expected or 1))).alias("expected"), (F.col("t") / F.lit(float(whole.achieved or 1))).alias("achieved"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def plan(docs: DataFrame, targets: Targets, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, source, language, topic, n_tokens, weight, probability, selected, copies.

    ``copies`` is how often the row is taken: 0 or 1, or more with ``repeat``.
    Null sources and languages are the value "(none)"; null texts count as
    empty; an empty table gives an empty table.  Repeated rows share one fate.
    """
    table = cell_table(docs, targets, id_col, text_col, source_col, lang_col).select(*AXES, "weight", "probability")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), F.col(source_col).alias("s"), F.col(lang_col).alias("l"))
    labelled = _labelled(rows, [*AXES, "n_tokens"], F.col("s"), F.col("l"), F.col("t")).withColumn("u", chance(F.col("doc_id"), F.col("t"), targets.seed)).drop("t", "s", "l")
    return _with_cells(labelled, table).select("doc_id", *AXES, "n_tokens", "weight", "probability", copies(F.col("probability"), F.col("u")).alias("copies")).withColumn("selected", F.col("copies") > 0).select("doc_id", *AXES, "n_tokens", "weight", "probability", "selected", "copies")


def _with_cells(rows: DataFrame, table: DataFrame) -> DataFrame:
    small = table.limit(DRIVER_CELLS + 1).count() <= DRIVER_CELLS
    return rows.join(F.broadcast(table) if small else table, list(AXES))


def sample(docs: DataFrame, targets: Targets, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, that the plan selects, each as often as it says.

    Null sources and languages are a value of their own, null texts count as
    empty, an empty table gives an empty table, repeated rows share one fate,
    and columns of any name go through.
    """
    table = cell_table(docs, targets, id_col, text_col, source_col, lang_col)
    s, l, t, n, p, k = fresh(docs, "mix_source__", "mix_language__", "mix_topic__", "mix_tokens__", "mix_p__", "mix_copies__")
    labelled = _labelled(docs, [s, l, t, n], F.col(source_col), F.col(lang_col), F.col(text_col))
    small = table.select(F.col("source").alias(s), F.col("language").alias(l), F.col("topic").alias(t), F.col("probability").alias(p))
    joined = labelled.join(F.broadcast(small) if small.limit(DRIVER_CELLS + 1).count() <= DRIVER_CELLS else small, [s, l, t])
    taken = joined.withColumn(k, copies(F.col(p), chance(F.col(id_col), F.col(text_col), targets.seed))).filter(F.col(k) > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(k))).alias(k)).select(*docs.columns)
