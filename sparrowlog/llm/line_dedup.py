"""Line dedup with exact reference counts and sharded cuckoo filters.

State is a table of line keys with the number of documents that hold each,
and one cuckoo filter a shard of the keys that are frequent.  Adding documents
adds to the counts, deleting them takes away; keys that cross the threshold
enter or leave their shard's filter, so every change can be taken back.  A
line is looked up in its filter first and then, if the filter has it, in the
exact table: only the exact table decides.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, materialise, per_process, row_digest, stored, text_map
from .cuckoo import CuckooFilter, built

#: Frequent keys of a shard, about.
SHARD_KEYS = 1 << 15
#: Frequent keys up to which filters and keys go to every task (16 bytes a key and about 3 of filter: 20 MB).
BROADCAST_KEYS = 1 << 20
#: Lines that a task looks up in one shard's filter, about.
TASK_KEYS = 1 << 18


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)


def document_keys(docs: DataFrame, text_col: str = "text", least_chars: int = 1) -> DataFrame:
    """(digest, hi, lo): each document's distinct line keys of at least so many code points, by 128-bit hash."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, take = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            own = {k for k in map(line_key, _lines(text)) if len(k) >= least_chars and (least_chars <= 1 or len(k.decode("utf-8", "surrogatepass")) >= least_chars)}
            keys += map(_digest, own)
            take += [i] * len(own)
        h = _halves(keys)
        return pa.record_batch([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(h[:, i].astype(np.int64)) for i in (0, 1))], names=["digest", "hi", "lo"])

    text = F.col(text_col).cast("string")
    return arrow_map(docs.select(row_digest(text).alias("digest"), text.alias("text")), f, "digest binary, hi long, lo long")


def line_counts(docs: DataFrame, text_col: str = "text", least_chars: int = 1) -> DataFrame:
    """The exact table (hi, lo, n_docs)."""
    return document_keys(docs, text_col, least_chars).groupBy("hi", "lo").agg(F.count("*").alias("n_docs"))


def change_counts(counts: DataFrame, docs: DataFrame, sign: int = 1, text_col: str = "text", least_chars: int = 1) -> DataFrame:
    """Counts after adding (sign 1) or deleting (-1) documents; keys of no document go."""
    delta = line_counts(docs, text_col, least_chars).withColumn("n_docs", F.col("n_docs") * sign)
    return counts.unionByName(delta).groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs")).filter("n_docs > 0")


def _shard(shards: int):
    return F.pmod(F.col("lo"), F.lit(shards)).cast("int")


def build_filters(counts: DataFrame, least_docs: int, shards: int) -> DataFrame:
    """(shard, body): a cuckoo filter of each shard's keys that are in at least so many documents."""

    def f(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "body": [built(part.hi.to_numpy(np.int64).view(np.uint64)).to_bytes()]})

    return counts.filter(F.col("n_docs") >= least_docs).select("hi", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(f, "shard int, body binary")


def change_filters(filters: DataFrame, before: DataFrame, after: DataFrame, least_docs: int, shards: int) -> DataFrame:
    """Filters brought from the counts before to the counts after by inserting and deleting keys."""
    was = before.filter(F.col("n_docs") >= least_docs).select("hi", "lo", F.lit(1).alias("was"))
    now = after.filter(F.col("n_docs") >= least_docs).select("hi", "lo", F.lit(1).alias("now"))
    moved = was.join(now, ["hi", "lo"], "full_outer").filter("was is null or now is null").select("hi", _shard(shards).alias("shard"), F.col("now").isNotNull().alias("enters"))
    kept = now.select("hi", _shard(shards).alias("shard"))

    def f(key: tuple, old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        shard = CuckooFilter.from_bytes(old.body.iloc[0]) if len(old) else built(np.zeros(0, np.uint64))
        h = change.hi.to_numpy(np.int64).view(np.uint64)
        shard.delete(h[~change.enters.to_numpy(bool)])
        body = shard.to_bytes() if shard.insert(h[change.enters.to_numpy(bool)]) else None
        return pd.DataFrame({"shard": [key[0]], "body": [body]})

    changed = filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(f, "shard int, body binary")
    overfull = changed.filter("body is null").select("shard")
    rebuilt = kept.join(overfull, "shard", "left_semi").groupBy("shard").applyInPandas(lambda key, part: pd.DataFrame({"shard": [key[0]], "body": [built(part.hi.to_numpy(np.int64).view(np.uint64)).to_bytes()]}), "shard int, body binary")
    return changed.filter("body is not null").unionByName(rebuilt)


def shard_count(frequent: int) -> int:
    return max(1, -(-frequent // SHARD_KEYS))


class KeySet:
    """Exact set of 128-bit keys in two sorted arrays."""

    def __init__(self, body: bytes):
        pairs = np.frombuffer(body, np.int64).reshape(-1, 2).astype(np.uint64)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        self.hi, self.lo = pairs[order, 0], pairs[order, 1]

    def contains(self, h: np.ndarray) -> np.ndarray:
        a, z = np.searchsorted(self.hi, h[:, 0], "left"), np.searchsorted(self.hi, h[:, 0], "right")
        out = np.zeros(len(h), bool)
        once = z - a == 1
        out[once] = self.lo[a[once]] == h[once, 1]
        for i in np.flatnonzero(z - a > 1):  # keys that share their first half
            out[i] = h[i, 1] in self.lo[a[i] : z[i]]
        return out


def filter_hits(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The rows of ``keys`` (digest, hi, lo) that their shard's filter has.

    Keys meet their own shard's filter alone; a shard is dealt over as many
    tasks as its keys ask for, a common key among them by the texts.
    """
    salts = max(1, -(-keys.count() // (shards * TASK_KEYS)))
    mine = keys.withColumn("shard", _shard(shards)).withColumn("salt", F.pmod(F.xxhash64("digest", "hi"), F.lit(salts)).cast("int"))
    copies = filters.select("shard", "body", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def f(key: tuple, lines: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(lines):
            return lines.iloc[:0][["digest", "hi", "lo"]]
        held = CuckooFilter.from_bytes(own.body.iloc[0])
        return lines[held.contains(lines.hi.to_numpy(np.int64).view(np.uint64))][["digest", "hi", "lo"]]

    return mine.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(f, "digest binary, hi long, lo long")


def drop_lines(docs: DataFrame, counts: DataFrame, least_docs: int = 10, least_chars: int = 1, filters: DataFrame | None = None, shards: int | None = None, broadcast_keys: int = BROADCAST_KEYS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for each row of ``docs``.

    Lines whose key is in ``least_docs`` documents or more by ``counts`` go,
    in every document; the others stay as they are, joined by line feeds.
    Null and empty texts are one empty line; an empty table gives an empty
    table; repeated rows come out repeated, each counted as a document of its
    own; other columns are not read.  Keys shorter than ``least_chars`` never
    go.  Lines are looked up in their shard's filter, and what it has in the
    exact table.  Up to ``broadcast_keys`` frequent keys both go to each task;
    beyond, lines are dealt out by shard to its filter, hits are joined with
    the exact table, and the keys found are joined back to their texts.
    """
    frequent = counts.filter(F.col("n_docs") >= least_docs).select("hi", "lo")
    n = frequent.count()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_lines long, n_dropped long, kept_text string"
    shards = shards or shard_count(n)
    filters = build_filters(counts, least_docs, shards) if filters is None else filters
    if n <= broadcast_keys:
        exact = np.ascontiguousarray(frequent.select("hi", "lo").toPandas().to_numpy(np.int64)).tobytes()
        sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, shards, {r.shard: bytes(r.body) for r in filters.collect()}, exact))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, shards, bodies, body = sent.value
            held, exact = per_process("line-filters", own, lambda: ({k: CuckooFilter.from_bytes(v) for k, v in bodies.items()}, KeySet(body)))
            for batch in batches:
                texts = [_lines(t) for t in batch.column(1).to_pylist()]
                h = _halves([_digest(line_key(x)) for lines in texts for x in lines])
                maybe = np.zeros(len(h), bool)
                where = h[:, 1].astype(np.int64) % shards
                for k, f in held.items():
                    own_lines = np.flatnonzero(where == k)
                    maybe[own_lines] = f.contains(h[own_lines, 0])
                hits = np.flatnonzero(maybe)
                drop = np.zeros(len(h), bool)
                drop[hits] = exact.contains(h[hits])
                yield _rebuilt(batch, texts, drop, least_chars)

        return text_map(rows, run, schema, keeps=True)
    hits = filter_hits(stored(document_keys(docs, text_col, least_chars).distinct(), "line-keys"), filters, shards)
    per_text = hits.join(frequent, ["hi", "lo"], "left_semi").groupBy("digest").agg(F.collect_list(F.struct("hi", "lo")).alias("keys"))
    joined = rows.withColumn("digest", row_digest(F.col("text"))).join(materialise(per_text), "digest", "left").select("doc_id", "text", F.transform("keys", lambda k: k.hi).alias("hi"), F.transform("keys", lambda k: k.lo).alias("lo"))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [_lines(t) for t in batch.column(1).to_pylist()]
        drop = []
        for lines, hi, lo in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            own = set(zip(hi or (), lo or ()))
            for x in lines:
                d = _digest(line_key(x))
                drop.append(bool(own) and (int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)) in own)
        return _rebuilt(batch, texts, np.array(drop, bool), least_chars)

    return arrow_map(joined, f, schema)


def _rebuilt(batch: pa.RecordBatch, texts: list[list[bytes]], drop: np.ndarray, least_chars: int) -> pa.RecordBatch:
    n_dropped, kept, at = [], [], 0
    for lines in texts:
        gone = drop[at : at + len(lines)]
        at += len(lines)
        n_dropped.append(int(gone.sum()))
        kept.append(b"\n".join(x for x, g in zip(lines, gone) if not g) if n_dropped[-1] else b"\n".join(lines))
    return pa.record_batch([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n_dropped, pa.int64()), pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])


def dedup_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, **more) -> DataFrame:
    """``drop_lines`` by the counts of ``docs`` itself."""
    return drop_lines(docs, materialise(line_counts(docs, more.get("text_col", "text"), least_chars)), least_docs, least_chars, **more)
