"""LambdaMART: gradient-boosted trees on pairwise lambdas weighted by the change of nDCG.

Features are binned once (up to BINS quantile bins, by percentiles of all
rows) and lists packed into chunks of numpy bytes, some thousands of lists a
row, with their scores, gradients and curvatures.  A round adds its last tree
to the scores, so no tree is applied twice, and sums gradients by (leaf,
feature, bin) with map-side combining, one pass a level: what goes to the
driver follows leaves x features x bins and not the rows.  Lambdas need only a
list's own rows: pairs of a clicked and an unclicked candidate of one
impression.  Every few rounds the chunks are written out, to cut the lineage.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..shared import stored

BINS = 32


@dataclass(frozen=True)
class Settings:
    """``feature_share`` and ``row_share``: of the features and lists each tree is grown from, chosen by hash of round and seed."""

    rounds: int = 40
    rate: float = 0.1
    leaves: int = 15
    least_rows: int = 50
    patience: int = 10
    ridge: float = 1.0
    cut: int = 10
    checkpoint_every: int = 5
    feature_share: float = 0.9
    row_share: float = 0.9
    seed: int = 13


@dataclass
class Tree:
    """Splits (node -> feature, bin, left, right) and leaf values."""

    splits: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def leaf_of(self, binned: np.ndarray) -> np.ndarray:
        node = np.zeros(len(binned), np.int64)
        for k in sorted(self.splits):
            f, b, left, right = self.splits[k]
            at = np.flatnonzero(node == k)
            node[at] = np.where(binned[at, f] <= b, left, right)
        return node

    def predict(self, binned: np.ndarray) -> np.ndarray:
        table = np.zeros(max([0, *self.values]) + 1)
        for k, v in self.values.items():
            table[k] = v
        return table[self.leaf_of(binned)]


@dataclass
class Model:
    features: tuple[str, ...]
    edges: list[np.ndarray]
    trees: list[Tree]
    gains: np.ndarray
    history: list[float]

    def importance(self) -> list[tuple[str, float]]:
        """Features by total gain, falling."""
        return sorted(zip(self.features, self.gains.tolist()), key=lambda x: (-x[1], x[0]))

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "edges": [e.tolist() for e in self.edges], "trees": [asdict(t) for t in self.trees], "gains": self.gains.tolist(), "history": self.history})

    @classmethod
    def from_json(cls, text: str) -> Model:
        m = json.loads(text)
        trees = [Tree({int(k): tuple(v) for k, v in t["splits"].items()}, {int(k): v for k, v in t["values"].items()}) for t in m["trees"]]
        return cls(tuple(m["features"]), [np.array(e, float) for e in m["edges"]], trees, np.array(m["gains"], float), m["history"])


def bin_edges(rows: DataFrame, features: tuple[str, ...]) -> list[np.ndarray]:
    at = [i / BINS for i in range(1, BINS)]
    row = rows.agg(*(F.percentile_approx(F.col(f).cast("double"), at, 2000).alias(f"q{i}") for i, f in enumerate(features))).first()
    return [np.unique(np.array(row[f"q{i}"] or [], float)) for i in range(len(features))]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, np.nan_to_num(x[:, i]), side="left") for i, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), int)


def _places(score: np.ndarray, pos: np.ndarray, of: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Place from 1 of each candidate in its list (``of``: the list's number, rising; ``starts``: where each list begins)."""
    order = np.lexsort((pos, -score, of))
    place = np.empty(len(score), np.int64)
    place[order] = np.arange(len(score)) - starts[of[order]] + 1
    return place


def _discounts(place: np.ndarray, cut: int) -> np.ndarray:
    return np.where(place <= cut, 1 / np.log2(place + 1.0), 0.0)


def _ideals(label: np.ndarray, of: np.ndarray, lists: int, cut: int) -> np.ndarray:
    best = np.concatenate([[0.0], np.cumsum(1 / np.log2(np.arange(2, cut + 2)))])
    return best[np.minimum(np.bincount(of, label, lists).astype(int), cut)]


def list_lambdas(score: np.ndarray, label: np.ndarray, pos: np.ndarray, sizes: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of each candidate of lists of these sizes, one after another."""
    of, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    discount = _discounts(_places(score, pos, of, starts), cut)
    ideal = _ideals(label, of, len(sizes), cut)
    clicked = np.flatnonzero(label == 1)
    each = sizes[of[clicked]]
    up = np.repeat(clicked, each)
    down = np.repeat(starts[of[clicked]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    pair = label[down] == 0
    up, down = up[pair], down[pair]
    delta = np.abs(discount[up] - discount[down]) / ideal[of[up]]
    rho = 1 / (1 + np.exp(np.clip(score[up] - score[down], -50, 50)))
    lam, cur, n = delta * rho, delta * rho * (1 - rho), len(score)
    return np.bincount(up, lam, n) - np.bincount(down, lam, n), np.bincount(up, cur, n) + np.bincount(down, cur, n)


def lambdas(score: np.ndarray, label: np.ndarray, pos: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of each candidate of one list."""
    return list_lambdas(score, label, pos, np.array([len(score)]), cut)


def list_ndcg(score: np.ndarray, label: np.ndarray, pos: np.ndarray, sizes: np.ndarray, cut: int) -> np.ndarray:
    """nDCG of each list."""
    of, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    gain = np.bincount(of, label * _discounts(_places(score, pos, of, starts), cut), len(sizes))
    return gain / _ideals(label, of, len(sizes), cut)


# ------------------------------------------------------------------ chunks

_CHUNK = "part string, key binary, sizes binary, x binary, y binary, pos binary, score binary, g binary, h binary"
_TYPES = {"key": np.uint64, "sizes": np.int64, "x": np.uint8, "y": np.float64, "pos": np.int64, "score": np.float64, "g": np.float64, "h": np.float64}


def _arrays(batch: pa.RecordBatch, i: int) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in _TYPES.items()}


def _chunk_row(part: str, a: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part]), *(pa.array([np.ascontiguousarray(a[c], t).tobytes()], pa.binary()) for c, t in _TYPES.items())], names=["part", *_TYPES])


def _chunks(rows: DataFrame, part: str, edges: list[np.ndarray], features: tuple[str, ...], by: str, cut: int) -> DataFrame:
    """Chunks of the lists that have both classes, each in order of position, with scores of 0."""
    item = F.struct(F.col("pos").cast("long").alias("pos"), F.col("label").cast("double").alias("y"), F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features)).alias("x"))
    lists = rows.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("m"), F.sum("label").alias("clicks"), F.count("*").alias("n"))
    lists = lists.filter("clicks > 0 and clicks < n").select(F.xxhash64(by).alias("key"), "m")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column("m")
            flat = m.flatten()
            x = flat.field("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(features))
            a = {"key": batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), "sizes": m.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), "x": _binned(x, edges), "y": flat.field("y").to_numpy(zero_copy_only=False), "pos": flat.field("pos").to_numpy(zero_copy_only=False)}
            a["score"] = np.zeros(len(x))
            a["g"], a["h"] = list_lambdas(a["score"], a["y"], a["pos"], a["sizes"], cut)
            yield _chunk_row(part, a)

    return lists.mapInArrow(f, _CHUNK)


def _grown(chunks: DataFrame, tree: Tree, width: int, s: Settings) -> DataFrame:
    """The chunks with the tree's values added to the scores, and the gradients of those."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a = _arrays(batch, i)
                a["score"] = a["score"] + s.rate * tree.predict(a["x"].reshape(-1, width))
                a["g"], a["h"] = list_lambdas(a["score"], a["y"], a["pos"], a["sizes"], s.cut)
                yield _chunk_row(batch.column("part")[i].as_py(), a)

    return chunks.mapInArrow(f, _CHUNK)


def chosen_lists(key: np.ndarray, turn: int, s: Settings) -> np.ndarray:
    """Which lists the tree of this round is grown from, by hash."""
    z = (key + np.uint64((0x9E3779B97F4A7C15 * (turn * 1_000_003 + s.seed + 1)) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 < s.row_share


def histogram(leaf: np.ndarray, x: np.ndarray, g: np.ndarray, h: np.ndarray, leaves: list[int]) -> np.ndarray:
    """[leaf, feature, bin, 3]: rows, gradients and curvatures."""
    width, rank = x.shape[1], np.full(max(leaves) + 1, -1)
    rank[leaves] = np.arange(len(leaves))
    own = np.flatnonzero(rank[leaf] >= 0)
    at = ((rank[leaf[own], None] * width + np.arange(width)) * BINS + x[own]).ravel()
    size = len(leaves) * width * BINS
    return np.stack([np.bincount(at, w, size) for w in (None, np.repeat(g[own], width), np.repeat(h[own], width))], axis=1).reshape(len(leaves), width, BINS, 3)


def _statistics(chunks: DataFrame, tree: Tree, leaves: list[int], width: int, turn: int, s: Settings) -> tuple[np.ndarray, float]:
    """The training lists' histogram of these leaves, and val's mean nDCG by the scores so far."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gain, n = np.zeros((len(leaves), width, BINS, 3)), 0.0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                a = _arrays(batch, i)
                if batch.column("part")[i].as_py() == "val":
                    gain += float(list_ndcg(a["score"], a["y"], a["pos"], a["sizes"], s.cut).sum())
                    n += len(a["sizes"])
                    continue
                x, own = a["x"].reshape(-1, width), np.repeat(chosen_lists(a["key"], turn, s), a["sizes"])
                total += histogram(tree.leaf_of(x[own]), x[own], a["g"][own], a["h"][own], leaves)
        flat = total.reshape(-1, 3)
        at = np.flatnonzero(flat[:, 0])
        yield pa.record_batch([pa.array(np.append(at, -1), pa.int64()), *(pa.array(np.append(flat[at, k], x), pa.float64()) for k, x in ((0, float(n)), (1, gain), (2, 0.0)))], names=["at", "n", "g", "h"])

    got = chunks.mapInArrow(f, "at long, n double, g double, h double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
    out, val = np.zeros((len(leaves) * width * BINS, 3)), got[got["at"] == -1]
    got = got[got["at"] >= 0]
    out[got["at"].to_numpy()] = got[["n", "g", "h"]].to_numpy()
    return out.reshape(len(leaves), width, BINS, 3), float(val.g.sum() / max(1.0, val.n.sum()))


def best_split(grid: np.ndarray, allowed: np.ndarray, s: Settings) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of one leaf's histogram [feature, bin, 3]; ties go to the least feature and bin."""
    n, g, h = (grid[:, :, k].cumsum(axis=1) for k in range(3))
    whole = lambda g, h: g * g / (h + s.ridge)
    gain = whole(g, h) + whole(g[:, -1:] - g, h[:, -1:] - h) - whole(g[:, -1:], h[:, -1:])
    gain[(n < s.least_rows) | (n[:, -1:] - n < s.least_rows) | ~allowed[:, None]] = -1
    gain = np.round(gain, 9)
    i = int(gain.argmax())
    f, b = divmod(i, gain.shape[1])
    return (float(gain[f, b]), f, b) if gain[f, b] > 1e-9 else None


def _value(sums: np.ndarray, s: Settings) -> float:
    return float(sums[1] / (sums[2] + s.ridge))


def grow(statistics, width: int, turn: int, s: Settings, gains: np.ndarray) -> tuple[Tree, float]:
    """A tree, level by level, the greatest gains first; ``statistics(tree, leaves)`` gives a level's histogram and val's nDCG."""
    allowed = np.zeros(width, bool)
    allowed[np.random.default_rng([s.seed, turn]).permutation(width)[: max(1, round(s.feature_share * width))]] = True
    tree, open_leaves, count, quality = Tree(), [0], 1, None
    while open_leaves and count < s.leaves:
        grids, ndcg = statistics(tree, open_leaves)
        quality = ndcg if quality is None else quality
        found = sorted(((best_split(grid, allowed, s), k, grid) for k, grid in zip(open_leaves, grids)), key=lambda x: (-(x[0][0] if x[0] else 0), x[1]))
        open_leaves = []
        for split, k, grid in found:
            tree.values.setdefault(k, _value(grid[0].sum(axis=0), s))
            if split is None or count >= s.leaves:
                continue
            gain, feature, cut = split
            top = 2 * len(tree.splits)
            left = grid[feature, : cut + 1].sum(axis=0)
            del tree.values[k]
            tree.splits[k] = (feature, cut, top + 1, top + 2)
            tree.values |= {top + 1: _value(left, s), top + 2: _value(grid[feature].sum(axis=0) - left, s)}
            gains[feature] += gain
            open_leaves += [top + 1, top + 2]
            count += 1
    return tree, quality or 0.0


def fit(train: DataFrame, val: DataFrame, features: tuple[str, ...], settings: Settings = Settings(), by: str = "imp") -> Model:
    """Boosts until ``rounds`` or until val nDCG stands still for ``patience`` rounds; keeps the best round.

    ``train`` and ``val``: by, pos, label and the features.  Trees grow level
    by level, all leaves of a level from one pass over the chunks.
    """
    edges = bin_edges(train, features)
    width, s = len(features), settings
    chunks = stored(_chunks(train, "train", edges, features, by, s.cut).unionByName(_chunks(val, "val", edges, features, by, s.cut)), "ranker")
    held, trees, gains, history = None, [], np.zeros(width), []
    try:
        for turn in range(s.rounds + 1):
            tree, ndcg = grow(lambda t, leaves: _statistics(chunks, t, leaves, width, turn, s), width, turn, s, gains)  # noqa: B023
            if turn:
                history.append(ndcg)  # by the trees before this one
            if turn == s.rounds or not tree.splits or history and len(history) - 1 - int(np.argmax(history)) >= s.patience:
                break
            trees.append(tree)
            grown = _grown(chunks, tree, width, s)
            chunks = stored(grown, "ranker") if (turn + 1) % s.checkpoint_every == 0 else grown.persist()
            before, held = held, chunks if (turn + 1) % s.checkpoint_every else None
            if before is not None:
                chunks.count() if held is not None else None
                before.unpersist()
    finally:
        if held is not None:
            held.unpersist()
    best = int(np.argmax(history)) + 1 if history else 0
    return Model(features, edges, trees[:best], gains, history)


def predict(rows: DataFrame, model: Model, rate: float = Settings.rate, name: str = "score") -> DataFrame:
    """``rows`` with the model's score; a vectorised function of the features."""

    @F.pandas_udf("double")
    def scored(x: pd.DataFrame) -> pd.Series:
        binned = _binned(x.to_numpy(float), model.edges)
        return pd.Series(rate * sum((t.predict(binned) for t in model.trees), np.zeros(len(binned))))

    return rows.withColumn(name, scored(F.struct(*(F.col(f).cast("double") for f in model.features))))


def negative_samples(candidates: DataFrame, ratio: int = 4, seed: int = 13, by: str = "imp") -> DataFrame:
    """(by, item, negatives): for each click ``ratio`` unclicked candidates of its list, chosen by hash.

    With fewer unclicked candidates than that, they repeat; lists without any give no row.
    """
    def digest(*columns: str) -> Column:
        return F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in columns), F.lit(str(seed))).cast("binary"))

    pool = candidates.filter("label = 0").groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(digest(by, "item").alias("h"), "item"))), lambda x: x.item).alias("pool"))
    first = (F.conv(F.substring(digest("item"), 1, 15), 16, 10).cast("long") % F.size("pool")).cast("int")
    picked = F.transform(F.sequence(F.lit(0), F.lit(ratio - 1)), lambda i: F.get("pool", (first + i) % F.size("pool")))
    return candidates.filter("label = 1").select(by, "item").join(pool, by).select(by, "item", picked.alias("negatives"))


def truncate_pad(history: Column, length: int, pad: str = "") -> Column:
    """The last ``length`` items, padded in front."""
    from ..functions.columns import last_n

    kept = last_n(F.coalesce(history, F.array().cast("array<string>")), length)
    return F.concat(F.array_repeat(F.lit(pad), F.lit(length) - F.size(kept)), kept)
