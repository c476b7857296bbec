"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint has 64 bits, each the majority over the XXH64 hashes of a text's
word shingles.  Segments of a fingerprint are decoded to nearby codewords of
the Golay code, which gives several keys each (see ``golay``); documents that
share a key are compared.  Equal fingerprints are one node, so exact copies
cost one row.  A key held by few nodes gives its pairs; a key held by many is
never paired out:

* within two bits, its nodes are linked exactly through one-bit variants: two
  fingerprints are within two bits if and only if they share one of their 65
  (the word itself and each single-bit flip), so every group of equal variants
  is a star of true links;
* near copies by Jaccard similarity are verified by their shingles, and what the
  keys miss is found by prefixes of rare shingles (see ``similar_links``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import golay
from .common import LONG_MIN, arrow_map, keep_rows, lower_ascii_words, materialise, release, row_digest, shingle_hashes, stored
from .components import components

#: Nodes of a key up to which all their pairs are compared.
PAIRED_NODES = 24
_CHUNK = 1 << 15


def majority(hashes: np.ndarray) -> int:
    """Bit by bit: 1 if set in over half of the 64-bit hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at : at + _CHUNK]).astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def simhash(text: str | None, width: int = 3) -> int:
    """Unsigned fingerprint of the word shingles of a text; 0 if it has no word."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.fromiter((simhash(t, width) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        return pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), f, "doc_id long, fp long")


def _keyed(nodes: DataFrame, columns: list[str], carry: bool = False) -> DataFrame:
    """(key, node) for each Golay key of each fingerprint of each node; with ``carry`` also f, the fingerprint.

    Keys of different fingerprint columns never meet.
    """

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for k in range(len(columns)):
            fp = batch.column(1 + k).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, key = golay.exact_and_fuzzy_keys(fp.view(np.uint64))
            parts.append((key | k << 44, rows, fp[rows]))
        key, rows, fp = (np.concatenate(x) for x in zip(*parts))
        out = [pa.array(key), batch.column(0).take(pa.array(rows)), pa.array(fp)]
        return pa.record_batch(out if carry else out[:2], names=["key", "node", "f"][: len(out) if carry else 2])

    return arrow_map(nodes.select("node", *columns), f, "key long, node long" + ", f long" * carry)


def links_within_two(nodes: DataFrame) -> DataFrame:
    """(u, v), u < v, each once: links whose components are those of all pairs of fingerprints within two bits.

    ``nodes`` has one column ``fp``, without repeats.
    """
    keyed = stored(_keyed(nodes.select("fp", F.col("fp").alias("node")), ["fp"]), "golay-keys")
    held = materialise(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("u"), F.max("node").alias("v")).filter("n > 1"))
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2
    twos = held.filter("n = 2").filter(close).select("u", "v")
    some = keyed.join(held.filter(f"n > 2 and n <= {PAIRED_NODES}").select("key"), "key").groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("m"))
    pairs = some.select(F.explode(_pairs_within("m", 2)).alias("p")).select("p.u", "p.v")
    hot = keyed.join(held.filter(f"n > {PAIRED_NODES}").select("key"), "key", "left_semi").select("node").distinct()
    return twos.unionByName(pairs).unionByName(_stars(hot)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _pairs_within(column: str, bits: int):
    """Pairs of a short array of fingerprints that differ in so few bits."""
    m = F.col(column)
    return F.flatten(
        F.transform(m, lambda a, i: F.transform(F.filter(F.slice(m, i + 2, F.size(m)), lambda b: F.bit_count(a.bitwiseXOR(b)) <= bits), lambda b: F.struct(a.alias("u"), b.alias("v"))))
    )


def _stars(nodes: DataFrame) -> DataFrame:
    """Stars over nodes that share a variant with at most one bit flipped."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(v) for v in (1 << np.arange(64, dtype=np.uint64)).view(np.int64).tolist()))
    variants = nodes.select("node", F.explode(flips).alias("flip")).select("node", F.col("node").bitwiseXOR(F.col("flip")).alias("variant"))
    centre = variants.groupBy("variant").agg(F.min("node").alias("v"), F.count("*").alias("n")).filter("n > 1").select("variant", "v")
    return variants.join(centre, "variant").filter("node <> v").select(F.col("node").alias("u"), "v")


def near_dedup(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id.

    fingerprint: 16 hex digits.  component_id: the least doc_id reachable over
    fingerprints that differ in two bits or fewer (null only if no document of
    the component has an id).  Null, empty and wordless texts have fingerprint
    zero and are linked like any other.  Repeated rows come out repeated; an
    empty table gives an empty table; other columns are not read.
    """
    thin = materialise(fingerprints(docs, width, id_col, text_col))
    groups = materialise(thin.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = materialise(links_within_two(groups.select("fp")))
    tree = components(links)
    rooted = groups.join(tree, groups.fp == tree.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted)
    top = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(rooted.join(top, "root").select("fp", "component_id"))
    return thin.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ------------------------------------------------------------------ similarity


#: Fingerprints over distinct words that are decoded for the first links; what they miss is found by ``rest_links``.
FINGERPRINTS = 1
#: Differing bits up to which such fingerprints are candidates of the first links.
WORD_BITS = 10
#: Counts of a document's distinct shingles by hash.
BINS = 256
#: Documents whose shingles are counted at least, the share of all that is counted at least, and counts kept, to order shingles by
#: how common they are. Any order gives the same links; of a fixed number of documents, what few of many share would look rare.
ORDER_DOCS, ORDER_SHARE, ORDER_SHINGLES = 5_000, 8, 1 << 18
#: While more pairs than so many a row are open and at least one in so many is a link, each key's nodes are compared with
#: one more centre; then all that are left are paired out. The links' components are the same whatever these are.
PAIRS_A_ROW, TRIED_A_LINK = 8, 50
#: Nodes up to which those to be verified are broadcast to the texts (under 100 bytes each); beyond, a join.
BROADCAST_NODES = 200_000


def _node(shingles: np.ndarray) -> int:
    """Signed 64-bit hash of a set of shingles, rising."""
    h = xxhash.xxh64_intdigest(shingles.tobytes(), 7)
    return h - (1 << 64) if h >> 63 else h


def signed_documents(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, node, size, bins, f0, ...): node and size are of the set of shingles, bins counts it by hash, f0, ... are over distinct words."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        node, size, bins, out = [], [], [], np.zeros((FINGERPRINTS, n), np.uint64)
        for i, text in enumerate(batch.column(2).to_pylist()):
            words = set(lower_ascii_words(text))
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
            shingles = np.unique(shingle_hashes(text, width))
            node.append(_node(shingles))
            size.append(len(shingles))
            counts = np.bincount((shingles % np.uint64(BINS)).astype(np.int64), minlength=BINS)
            bins.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
            for k in range(FINGERPRINTS if words else 0):
                out[k, i] = majority(_mixed(hashes, k))
        own = [pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(bins, pa.binary())]
        return pa.record_batch([batch.column(0), batch.column(1), *own, *(pa.array(x.view(np.int64)) for x in out)], names=["doc_id", "digest", "node", "size", "bins", *_prints()])

    return arrow_map(_rows(docs, id_col, text_col), f, "doc_id long, digest binary, node long, size long, bins binary, " + ", ".join(f"{c} long" for c in _prints()))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_digest(F.col(text_col)).alias("digest"), F.col(text_col).cast("string").alias("text"))


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Another 64-bit hash from each hash (the finaliser of splitmix64)."""
    z = hashes + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _prints() -> list[str]:
    return [f"f{k}" for k in range(FINGERPRINTS)]


def first_candidates(nodes: DataFrame) -> DataFrame:
    """(u, v) nodes that share a Golay key of a fingerprint and are within WORD_BITS in it; of a key with many nodes only those with its least.

    These only shorten ``rest_candidates``, which is complete.
    """
    keyed = _keyed(nodes, _prints(), carry=True)
    held = materialise(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min_by(F.struct("node", "f"), "node").alias("u"), F.max("node").alias("v")).filter("n > 1"))
    stars = keyed.join(held.select("key", "u"), "key").filter((F.col("node") != F.col("u.node")) & (F.bit_count(F.col("f").bitwiseXOR(F.col("u.f"))) <= WORD_BITS))
    return stars.select(F.col("u.node").alias("u"), F.col("node").alias("v")).distinct()


def common_shingles(docs: DataFrame, n: int, width: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a sample of documents hold, rising, and their counts."""
    turns = max(1, min(n // ORDER_DOCS, ORDER_SHARE))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, width)) for t in batch.column(2).to_pylist()]
        return pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], names=["key"])

    some = _rows(docs, id_col, text_col).filter(F.pmod(F.xxhash64("digest"), F.lit(turns)) == 0)
    counts = arrow_map(some, f, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "key").limit(ORDER_SHINGLES).toPandas()
    key = counts.key.to_numpy(np.int64).view(np.uint64)
    at = np.argsort(key)
    return key[at], counts.n.to_numpy(np.int64)[at]


def prefix_keys(docs: DataFrame, width: int, common: tuple[np.ndarray, np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """(key, node, size, at): the first shingles of each set, rarest first; ``at`` is the place in that order.

    Sets of m <= n shingles with a similarity of 4/5 share more than 4/9 (m + n),
    so the first one they share is among the first n - ceil(4n / 5) + 1 of the
    larger and the first m - ceil(8m / 9) + 1 of the smaller.
    """

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, counts = common
        parts = []
        for text in batch.column(2).to_pylist():
            s = np.unique(shingle_hashes(text, width))
            n = len(s)
            if not n:
                continue
            often = np.zeros(n, np.int64)
            if len(known):
                where = np.minimum(np.searchsorted(known, s), len(known) - 1)
                often = np.where(known[where] == s, counts[where], 0)
            first = s[np.lexsort((s, often))][: n + (-4 * n // 5) + 1]
            parts.append((first.view(np.int64), np.full(len(first), _node(s)), np.full(len(first), n), np.arange(len(first))))
        columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4
        return pa.record_batch([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.int32, np.int32))], names=["key", "node", "size", "at"])

    return arrow_map(_rows(docs, id_col, text_col), f, "key long, node long, size int, at int")


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose key several nodes have, each once; keys that no smaller set has among its first go."""
    short = F.col("at") <= F.col("size") - F.ceil(8 * F.col("size") / 9)
    held = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.max(short).alias("s")).filter("a <> b and s").select("key")
    return materialise(keyed.join(held, "key", "left_semi").distinct())


def _may_link(a, b):
    """Of two structs with size and at, whether the rest of both sets can hold enough: 9 common >= 4 (m + n)."""
    return 9 * F.least(a["size"] - a["at"], b["size"] - b["at"]) >= 4 * (a["size"] + b["size"])


def undecided(shared: DataFrame, tree: DataFrame) -> DataFrame:
    """(key, root, node, size, at) of the keys that nodes of several components of ``tree`` share."""
    rooted = shared.join(tree, "node", "left").select("key", F.coalesce("root", "node").alias("root"), "node", "size", "at")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
    return materialise(rooted.join(mixed, "key", "left_semi"))


def cross_pairs(rows: DataFrame) -> int:
    """How many pairs of nodes of different components share a key, each counted for every key."""
    own = rows.groupBy("key", "root").agg(F.count("*").cast("double").alias("n"))
    row = own.groupBy("key").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs")).agg(F.sum("pairs")).first()
    return int(row[0] or 0)


def centres(rows: DataFrame) -> DataFrame:
    """(key, c): each key's centre, the node whose share of shingles rarer than the key is least.

    Copies of one text that were each edited apart are nearer to the one with the fewest edits than to one another.
    """
    return rows.groupBy("key").agg(F.min_by(F.struct("node", "root", "size", "at"), F.struct(F.col("at") / F.col("size"), "node")).alias("c"))


def star_candidates(rows: DataFrame, centre: DataFrame) -> DataFrame:
    """(u, v) of each key's centre and the key's nodes of other components."""
    both = rows.join(centre, "key").filter((F.col("root") != F.col("c.root")) & _may_link(F.struct("node", "root", "size", "at"), F.col("c")))
    return both.select(F.least("node", "c.node").alias("u"), F.greatest("node", "c.node").alias("v")).distinct()


def merged_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with one key in place of all those that the same nodes share, and each node's first place among these.

    Copies share one key for each word of what they have in common; their pairs are the same under all of these.
    The first place lets on whatever any of the keys would.  Sets of nodes are told apart by their number and 128 bits.
    """
    sets = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    one = Window.partitionBy("n", "x", "y")
    named = sets.select("key", F.min("key").over(one).alias("of"))
    return rows.join(named, "key").groupBy(F.col("of").alias("key"), "root", "node", "size").agg(F.min("at").alias("at"))


def rest_candidates(rows: DataFrame) -> DataFrame:
    """(u, v) of all nodes of different components that share a key and may be similar."""
    a, b = (rows.select("key", F.struct("node", "root", "size", "at").alias(c)) for c in "ab")
    pairs = a.join(b, "key").filter((F.col("a.root") < F.col("b.root")) & _may_link(F.col("a"), F.col("b")))
    return pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def similar(candidates: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """The candidates whose sets of shingles have a Jaccard similarity of 0.8 or more: exact, by the sets.

    Counts by hash go first: they differ by no more than the sets do, so no similar pair is lost.
    """

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(n, BINS).astype(np.int16) for k in (4, 5))
        near = 9 * np.abs(a - b).sum(axis=1, dtype=np.int64) <= size
        return pa.record_batch([c.filter(pa.array(near)) for c in batch.columns[:4]], names=["u", "v", "m", "n"])

    s = nodes.select("node", "size", "bins")
    two = candidates.join(s.select(F.col("node").alias("u"), F.col("size").alias("m"), F.col("bins").alias("a")), "u").join(s.select(F.col("node").alias("v"), F.col("size").alias("n"), F.col("bins").alias("b")), "v")
    left = materialise(arrow_map(two.select("u", "v", "m", "n", "a", "b"), f, "u long, v long, m long, n long"))
    asked = left.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    where = materialise(nodes.join(asked, "node", "left_semi").select("node", F.coalesce("first.doc_id", F.lit(LONG_MIN)).alias("doc_id"), F.col("first.digest").alias("digest")))
    small = where.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    texts = _rows(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(LONG_MIN))).join(F.broadcast(where) if small else where, ["doc_id", "digest"])

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["node", "s"])

    held = materialise(arrow_map(texts.select("node", "text"), sets, "node long, s array<long>").dropDuplicates(["node"]))
    pairs = left.join(held.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(held.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    return materialise(pairs.filter(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.col("m") + F.col("n"))).select("u", "v"))


def similar_links(nodes: DataFrame, docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(u, v) links whose components are those of all pairs of nodes with a Jaccard similarity of 0.8 or more.

    First come pairs by the fingerprints' Golay keys.  Then rare shingles
    give all others (``prefix_keys``): first each key's nodes with the key's
    centre, in rounds with another centre each, and at last every pair that
    isn't in one component by then.
    """
    def check(pairs: DataFrame) -> DataFrame:
        release(docs.sparkSession)
        return similar(pairs, nodes, docs, width, id_col, text_col)

    links = check(first_candidates(nodes))
    common = common_shingles(docs, nodes.count(), width, id_col, text_col)
    shared = shared_keys(stored(prefix_keys(docs, width, common, id_col, text_col), "prefixes"))
    rows, used = undecided(shared, components(links)), None
    while cross_pairs(rows) > PAIRS_A_ROW * rows.count():
        centre = materialise(centres(rows))
        tried = materialise(star_candidates(rows, centre))
        found = check(tried)
        links = links.unionByName(found)
        own = centre.select("key", F.col("c.node").alias("node"))
        used = own if used is None else used.unionByName(own)
        rows = undecided(shared.join(used, ["key", "node"], "left_anti"), components(links))
        if found.count() * TRIED_A_LINK < tried.count():
            break
    return links.unionByName(check(rest_candidates(materialise(merged_keys(rows)))))


def drop_near_copies(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with the least doc_id of each group of near copies.

    Near: distinct five-word shingles with a Jaccard similarity of 0.8 or
    more, and what such pairs connect.  Null, empty and wordless texts are exact
    copies of one another.  Ids used twice are told apart by their texts, a
    null id counts as the least, of repeated rows one stays.  An empty table
    gives an empty table, and columns of any name go through.
    """
    rows = materialise(signed_documents(docs, width, id_col, text_col))
    nodes = materialise(rows.groupBy("node").agg(*(F.min(c).alias(c) for c in ["size", "bins", *_prints()]), F.min(F.struct("doc_id", "digest")).alias("first")))
    tree = components(similar_links(nodes, docs, width, id_col, text_col))
    release(docs.sparkSession)
    rooted = materialise(nodes.join(tree, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    top = rooted.groupBy("root").agg(F.min("first").alias("stays"))
    named = materialise(rooted.join(top, "root").select("node", "stays"))
    placed = rows.join(named, "node").select("doc_id", "digest", "stays")
    gone = placed.filter(~F.struct("doc_id", "digest").eqNullSafe(F.col("stays"))).select("doc_id", "digest").distinct()
    again = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "digest")
    return keep_rows(docs, gone, again, id_col, text_col)
