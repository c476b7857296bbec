"""Document fingerprints: one-permutation MinHash with optimal densification.

Every shingle hash is computed once and falls into one of BINS bins by its
highest bits; a bin keeps its least hash.  An empty bin takes the value of the
first full bin in its own fixed sequence of probes (optimal densification), so
bins stay independent.  Of each value the lowest BITS bits are stored.
Likeness is the share of equal bins, corrected for chance matches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import LONG_MIN, arrow_map, chunk_count, chunks_of, order_splits, shingle_hashes

BINS, BITS = 512, 4
SHINGLE_WORDS = 5
_BIN_BITS = BINS.bit_length() - 1


def _probe(bins: np.ndarray, attempts: np.ndarray) -> np.ndarray:
    """The bin that an empty bin looks at in an attempt; the same for all documents."""
    z = (bins.astype(np.uint64)[None, :] << np.uint64(32)) + attempts.astype(np.uint64)[:, None] + np.uint64(1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) % np.uint64(BINS)).astype(np.int64)


def densify(values: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Fills the bins that aren't full; at least one must be."""
    out, empty, first, many = values.copy(), np.flatnonzero(~full), 0, 16
    while len(empty):
        at = _probe(empty, np.arange(first, first + many))
        hit = full[at]
        found = hit.any(axis=0)
        source = at[hit.argmax(axis=0), np.arange(len(empty))]
        out[empty[found]] = values[source[found]]
        empty, first, many = empty[~found], first + many, min(4 * many, 1024)
    return out


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> bytes:
    """BINS x BITS bits; no bytes at all for a text without words. Equal shingle sets give equal bytes."""
    hashes = np.sort(shingle_hashes(text, width))
    if not len(hashes):
        return b""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - _BIN_BITS)
    first = np.minimum(np.searchsorted(hashes, edges), len(hashes) - 1)
    values = hashes[first]
    full = (values >> np.uint64(64 - _BIN_BITS)) == np.arange(BINS, dtype=np.uint64)
    low = (densify(values, full) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    bits = np.unpackbits(low[:, None], axis=1)[:, 8 - BITS :]
    return np.packbits(bits).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of the shingle sets, from 0 to 1; two without words are alike."""
    if not a or not b:
        return float(a == b)
    x = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(BINS, BITS)
    chance = 2.0**-BITS
    return float(np.clip(((1 - x.any(axis=1).mean()) - chance) / (1 - chance), 0, 1))


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint binary) for each row; null and wordless texts have an empty one."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "fingerprint"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), f, "doc_id long, fingerprint binary")


def edit_study(docs: DataFrame, share: int = 3, width: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How fingerprints tell a text from its edited form and from the next document.

    The next document is the one with the next smaller id; after the last, the
    first.  Edited: the last floor(n / share) code points replaced by the
    first as many (or all) of the next document's text.  Ids are cut into
    ranges; the first document of each range is also sent to the range before
    it, so no order is made over all rows in one task.  Rows with equal ids
    follow one another by falling text; null ids come last; null texts count
    as empty; an empty table gives an empty table; other columns are not
    read.  Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (hex), near_edited, near_next.
    """
    splits = order_splits(docs, id_col, chunk_count(docs.sparkSession))
    heads = {k: (j - 1) % len(splits) for j, k in enumerate(splits)}

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column(0).fill_null(LONG_MIN).to_numpy(zero_copy_only=False)
        chunk = chunks_of(splits, keys)
        prints = pa.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], pa.binary())
        again = [i for i, k in enumerate(keys.tolist()) if k in heads]
        take = pa.array(np.concatenate([np.arange(len(keys)), np.array(again, np.int64)]))
        chunks = np.concatenate([chunk, np.array([heads[int(keys[i])] for i in again], np.int32)]).astype(np.int32)
        halo = np.concatenate([np.zeros(len(keys), bool), np.ones(len(again), bool)])
        return pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), prints.take(take), pa.array(chunks), pa.array(halo)], names=["doc_id", "text", "fp", "chunk", "halo"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = arrow_map(rows, deal, "doc_id long, text string, fp binary, chunk int, halo boolean")
    order = Window.partitionBy("chunk").orderBy("halo", F.col("doc_id").desc_nulls_last(), F.desc("text"))
    n = F.char_length("text")
    k = F.floor(n / share).cast("int")
    edited = F.concat(F.substring("text", 1, n - k), F.substring("next_text", F.lit(1), k))
    pairs = (
        dealt.withColumns({"next_text": F.lead("text").over(order), "next_fp": F.lead("fp").over(order)})
        .filter("not halo")
        .select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
        .select("*", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    )

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp, after = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        own = [fingerprint(t, width) for t in batch.column(4).to_pylist()]
        return pa.record_batch(
            [batch.column(0), batch.column(1), batch.column(5), pa.array([x.hex() for x in fp]), pa.array([x.hex() for x in own]), pa.array(map(likeness, fp, own), pa.float64()), pa.array(map(likeness, fp, after), pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return arrow_map(pairs, compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
