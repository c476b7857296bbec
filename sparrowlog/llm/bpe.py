"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A text is split by the vocabulary's pattern; each word is a byte array that a
fold merges: every step joins the adjacent pair of least rank, taken from a
literal map of pairs to the rank of their union.  The map is a constant of two
arrays: where the row of a pair's first id begins, and all rows laid over one
another so that no two entries meet (row displacement), so a look-up is two
array reads and no hash.  The fold runs once for each of the distinct words
that are common in a bounded sample of the documents; their ids become a table
that every task gets.

Words outside the table are folded too, in one of two ways that give the same
ids.  ``tail="distinct"``, the default (``"heap"`` is its former name), splits the texts in an Arrow function
that looks up the common words and sends each word that it lacks on once a
task; Spark folds those, and a second Arrow function puts their ids in place,
all in one stage and without a shuffle.  ``tail="fold"`` folds each occurrence,
with the table as a second literal; it needs no Python, but a fold costs tens
of microseconds, and the README has the figures that rule it out at scale.
Words over LONG_WORD bytes are merged by a heap, since a fold takes the square
of a word's length.

Decoding is by higher-order functions: the pieces of the ids, in hexadecimal,
are joined and unhexed.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import among_least, release, release_executors, text_map
from .token_files import PATTERN as COMMON_PATTERN, UNCOMMON

#: Fixed value: how byte-level BPE splits a text before merging; white space as Unicode has it.
PATTERN = r"""(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for Python, whose \\s would also take the separators U+001C to U+001F.
_PYTHON_PATTERN = PATTERN.removeprefix("(?U)").replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
LONG_WORD = 200
#: Documents and code points of each of the sample; words of the table.
SAMPLE_DOCS, SAMPLE_CHARS, COMMON_WORDS = 8_000, 20_000, 1 << 18
_NONE = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of each token of a tiktoken file; ranks are ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# ------------------------------------------------------------- literal tables


def _two_places(keys: list, places: Callable[[object], tuple[int, int]], size: int) -> tuple[list[int], list[int]] | None:
    """Which key lies at each place of two tables (-1: none), or None if they don't fit."""
    tables = ([-1] * size, [-1] * size)
    at = [places(k) for k in keys]
    for i in range(len(keys)):
        side = 0
        for _ in range(500):
            place = at[i][side]
            i, tables[side][place] = tables[side][place], i
            if i < 0:
                break
            side = 0 if tables[1][at[i][1]] != -1 and at[i][0] != place and side else 1 - side
        else:
            return None
    return tables


def _literal(values: list, kind: str) -> Column:
    """A constant, folded when the plan is made."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), kind)


def _bound(constants: list[Column], f: Callable[..., Column]) -> Column:
    """f of the constants as lambda variables, so that each stands once in the plan however often it is used."""
    return _let(constants[0], lambda x: _bound(constants[1:], lambda *more: f(x, *more))) if constants else f()


#: A state's elements are rank << 24 | start << 16 | piece: of the pair that begins there, of its first byte, and id + 1.
_RANK, _START, _PIECE = 24, 16, (1 << 16) - 1
#: What stands before and after a word; least element whose pair has no union.
_FRONT, _END, _STOP = _NONE - 1, _NONE - 2, _NONE << _RANK


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _displaced(pairs: dict[tuple[int, int], int]) -> tuple[list[int], list[int]]:
    """Where each first piece's row begins, and the rows laid over one another: first piece << 16 | union at begin + second piece, 0 where there is none.

    Every begin plus any number below 65,536 is a place.
    """
    rows: dict[int, list[int]] = {}
    for a, b in pairs:
        rows.setdefault(a, []).append(b)
    begins, used, free = np.zeros(_NONE, np.int64), np.zeros(4 * _NONE, bool), 0
    for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):
        row = np.array(sorted(rows[a]))
        at = max(0, free - int(row[0]))
        while True:
            if at + 2 * _NONE > len(used):
                used = np.concatenate([used, np.zeros(len(used), bool)])
            fits = at + np.flatnonzero(~used[at + row[0] : at + row[0] + 4096])
            for b in row[1:]:
                fits = fits[~used[fits + b]]
                if not len(fits):
                    break
            if len(fits):
                break
            at += 4096
        begins[a] = fits[0]
        used[fits[0] + row] = True
        while used[free]:
            free += 1
    laid = [0] * (int(begins.max()) + _NONE)
    for (a, b), union in pairs.items():
        laid[begins[a] + b] = a << 16 | union
    return begins.tolist(), laid


class RankMap:
    """The literal rank map: pair of pieces -> rank of the union.

    ``constants`` are to be bound; ``fold`` takes them after the word, and
    ``fold_spelled`` the first two.  A piece is its id plus one.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= _END - 1:
            raise ValueError("ids must be below 65,533")
        pairs = {(ranks[t[:i]] + 1, ranks[t[i:]] + 1): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.constants = [_literal(values, "array<bigint>") for values in (*_displaced(pairs), byte_pieces(ranks).tolist())]

    def fold(self, word: Column, begins: Column, laid: Column, pieces: Column) -> Column:
        """The ids of a word."""
        latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
        return self.fold_spelled(F.transform(F.split(latin, ""), lambda c, i: F.shiftleft(i, _START).bitwiseOR(F.get(pieces, F.ascii(c)))), begins, laid)

    def fold_spelled(self, word: Column, begins: Column, laid: Column) -> Column:
        """The ids of a word given as start << 16 | piece of each byte: one merge of the pair of least rank, the first of its like, after another."""
        everything = F.lit(_NONE)

        def pair(a: Column, b: Column) -> Column:
            """The rank of a pair's union at its place in an element: _STOP or more if there is none."""
            return F.shiftleft(F.get(laid, F.get(begins, a) + b).bitwiseXOR(F.shiftleft(a, 16)), _RANK)

        def piece(element: Column) -> Column:
            return element.bitwiseAND(_long(_PIECE))

        def element(this: Column, following: Column) -> Column:
            this, following = this.cast("bigint"), F.coalesce(following, F.lit(_END)).cast("bigint")
            return pair(piece(this), piece(following)).bitwiseOR(this)

        def step(state: Column, _: Column) -> Column:
            def merged(p: Column) -> Column:
                least, before = F.get(state, p - 1), F.get(state, p - 2)
                union = F.shiftright(least, _RANK) + 1
                left = pair(piece(before), union).bitwiseOR(before.bitwiseAND(_long((1 << _RANK) - 1)))
                own = pair(union, piece(F.get(state, p + 1))).bitwiseOR(least.bitwiseAND(_long((1 << _RANK) - 1 - _PIECE))).bitwiseOR(union)
                return F.flatten(F.array(F.slice(state, F.lit(1), p - 2), F.array(left, own), F.slice(state, p + 2, everything)))

            least = F.array_min(state)
            return F.when(least < _long(_STOP), _let(F.array_position(state, least).cast("int"), merged)).otherwise(state)

        start = F.concat(F.array(_long(_STOP | _FRONT)), F.zip_with(word, F.slice(word, F.lit(2), everything), element), F.array(_long(_STOP | _END)))
        return F.aggregate(word, start, step, lambda state: F.transform(F.slice(state, F.lit(2), F.size(state) - 2), lambda e: piece(e) - 1))


def byte_pieces(ranks: dict[bytes, int]) -> np.ndarray:
    """The piece of each byte."""
    return np.array([ranks[bytes([b])] + 1 for b in range(256)], np.int32)


def spelled(words: list[str], pieces: np.ndarray) -> pa.ListArray:
    """Each word as ``fold_spelled`` takes it; words are of LONG_WORD bytes at most."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    starts = np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes)
    values = starts.astype(np.int32) << _START | pieces[np.frombuffer(b"".join(raw), np.uint8)]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values, pa.int32()))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once: where a fold of nothing begins, and so what it ends with."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda begun, _: begun, f)


def _word_places(word: str, bits: int) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
    mask = (1 << bits) - 1
    return h & mask, h >> 32 & mask


class WordMap:
    """A literal of words and their ids; ``constants`` are to be bound."""

    def __init__(self, ids: dict[str, list[int]]):
        words, self.bits = list(ids), max(4, len(ids).bit_length())
        while (held := _two_places(words, lambda w: _word_places(w, self.bits), 1 << self.bits)) is None:
            self.bits += 1
        self.constants = [_literal([None if i < 0 else words[i] for i in t], "array<string>") for t in held]
        self.constants += [_literal([None if i < 0 else ids[words[i]] for i in t], "array<array<bigint>>") for t in held]

    def ids_or(self, word: Column, words: tuple[Column, Column], ids: tuple[Column, Column], otherwise: Column) -> Column:
        mask = F.lit((1 << self.bits) - 1).cast("bigint")
        h = F.xxhash64(word)
        at = [h.bitwiseAND(mask).cast("int"), F.shiftright(h, 32).bitwiseAND(mask).cast("int")]
        return F.when(F.get(words[0], at[0]) == word, F.get(ids[0], at[0])).when(F.get(words[1], at[1]) == word, F.get(ids[1], at[1])).otherwise(otherwise)


# -------------------------------------------------------------- long words


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in time n log n: a heap of pairs over a linked list of pieces."""
    n = len(word)
    piece = [word[i : i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[word[i : i + 2]], i, 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            both = piece[i] + piece[after[i]]
            if both in ranks:
                heapq.heappush(heap, (ranks[both], i, len(both)))

    while heap:
        rank, i, size = heapq.heappop(heap)
        if not piece[i] or after[i] >= n:
            continue
        j = after[i]
        if len(piece[i]) + len(piece[j]) != size or ranks.get(piece[i] + piece[j]) != rank:
            continue
        piece[i] += piece[j]
        piece[j] = b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [ranks[p] for p in piece if p]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges of one word: by scanning if it is short, else by heap."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > 64:
        return heap_merge(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    scores = [ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
    while scores:
        best = min(scores)
        if best == _NONE:
            break
        i = scores.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i < len(scores):
            scores[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
        if i:
            scores[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
    return [ranks[p] for p in parts]


def _long_words(ranks: dict[bytes, int]):
    @F.pandas_udf("array<array<bigint>>")
    def merge(words: pd.Series) -> pd.Series:
        return pd.Series([[heap_merge(w.encode("utf-8", "surrogatepass"), ranks) for w in ws] for ws in words], dtype="object")

    return merge


# ------------------------------------------------------------------ operators


def sampled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text): SAMPLE_DOCS documents at most, those of least hashed id and text; what meets in one task is bounded, however large the table."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = docs.select(F.xxhash64(F.col(id_col).cast("long"), text).alias("h"), F.substring(text, 1, SAMPLE_CHARS).alias("text"))
    return hashed.filter(among_least(F.col("h"), docs.count(), SAMPLE_DOCS)).orderBy("h", "text").limit(SAMPLE_DOCS).select("text")


#: The literal rank map of the vocabulary used last; it depends on nothing else.
_rank_maps: dict[tuple, RankMap] = {}


def rank_map_of(ranks: dict[bytes, int]) -> RankMap:
    own = (len(ranks), hash(frozenset(ranks.items())))
    if own not in _rank_maps:
        _rank_maps.clear()
        _rank_maps[own] = RankMap(ranks)
    return _rank_maps[own]


def common_words(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", size: int | None = None) -> dict[str, bytes]:
    """The commonest words of a bounded sample and their 32-bit ids, folded by Spark; at most ``size`` (COMMON_WORDS) go to the driver.

    The fold runs in a session of its own that doesn't keep the printed plan, which has the rank map in it.
    """
    counts = sampled(docs, id_col, text_col).select(F.explode(F.regexp_extract_all("text", F.lit(PATTERN), 0)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = counts.filter(F.octet_length("word") <= LONG_WORD).orderBy(F.desc("n"), "word").limit(size or COMMON_WORDS).select("word")
    wanted = top.toArrow()
    rank_map = rank_map_of(ranks)
    release(docs.sparkSession)
    spark = docs.sparkSession.newSession()
    for key, value in (("spark.sql.maxPlanStringLength", "1000"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(key, value)
    words = spark.createDataFrame(wanted).repartition(spark.sparkContext.defaultParallelism, "word")
    folded = words.select("word", _bound(rank_map.constants, lambda *t: rank_map.fold(F.col("word"), *t)).cast("array<int>").alias("ids")).toArrow()
    out: dict[str, bytes] = {}
    for batch in folded.to_batches():  # packed as they come, for the driver's memory
        lists = batch.column(1)
        body, at = lists.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes(), lists.offsets.to_numpy()
        out.update((w, body[4 * a : 4 * z]) for w, a, z in zip(batch.column(0).to_pylist(), at, at[1:]))
    return out


def encode(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", tail: str = "distinct", table_size: int | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for each row; null and empty texts have no ids.

    As tiktoken's ``encode_ordinary`` with the same ranks and pattern.
    Repeated rows come out repeated; other columns are not read.
    """
    table = common_words(docs, ranks, id_col, text_col, table_size)
    release(docs.sparkSession)
    release_executors(docs.sparkSession)
    if tail != "fold":
        return _folded_once(docs, ranks, table, id_col, text_col)
    rank_map = rank_map_of(ranks)
    common = WordMap({w: np.frombuffer(i, "<i4").tolist() for w, i in table.items()})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_extract_all(text, F.lit(PATTERN), 0).alias("words"))
    long = F.array_distinct(F.filter("words", lambda w: F.octet_length(w) > LONG_WORD))
    merged = words.withColumn("long", long).withColumn("long_ids", _long_words(ranks)(F.col("long")))

    def all_ids(w1: Column, w2: Column, i1: Column, i2: Column, *ranked: Column) -> Column:
        def ids(w: Column) -> Column:
            short = common.ids_or(w, (w1, w2), (i1, i2), rank_map.fold(w, *ranked))
            return F.when(F.octet_length(w) > LONG_WORD, F.get("long_ids", (F.array_position("long", w) - 1).cast("int"))).otherwise(short)

        return F.flatten(F.transform("words", ids))

    return merged.select("doc_id", _bound([*common.constants, *rank_map.constants], all_ids).cast("array<int>").alias("ids"))


#: Folded words that a task keeps; documents that are split at once, and joined at once.
KEPT_WORDS, BATCH = 500_000, 128


class Entries(dict):
    """Little-endian 32-bit entries of words: ids of common and long words, and -1 - k for the k-th word to be folded; words met first are numbered and kept in ``new``."""

    def __init__(self, ranks: dict[bytes, int], table: dict[str, bytes]):
        super().__init__(table)
        self.ranks, self.new, self.folded = ranks, [], 0

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        if len(raw) > LONG_WORD:
            entries = np.array(merge(raw, self.ranks), "<i4").tobytes()
        else:
            self.folded += 1
            entries = (-self.folded).to_bytes(4, "little", signed=True)
            self.new.append(word)
        self[word] = entries
        return entries


class TailSplitter:
    """Entries of texts, and the words that are to be folded for them."""

    def __init__(self, ranks: dict[bytes, int], table: dict[str, bytes]):
        self.ranks, self.table = ranks, table
        self.common, self.any = re.compile(COMMON_PATTERN).findall, regex.compile(_PYTHON_PATTERN).findall
        self.entries = Entries(ranks, table)

    def split(self, texts: list[str]) -> tuple[list[bytes], list[str], bool]:
        """Entries of each text, words not numbered before, and whether numbers begin anew."""
        if anew := len(self.entries) - len(self.table) > KEPT_WORDS:
            self.entries = Entries(self.ranks, self.table)
        get, self.entries.new = self.entries.__getitem__, []
        return [b"".join(map(get, self.any(t) if UNCOMMON.search(t) else self.common(t))) for t in texts], self.entries.new, anew


class TailJoiner:
    """Ids of entries; keeps the ids of the words folded so far, by number."""

    def __init__(self):
        self.ids, self.ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]

    def add(self, ids: np.ndarray, sizes: np.ndarray, anew: bool) -> None:
        if anew:
            self.__init__()
        if len(sizes):
            self.ids.append(ids)
            self.ends.append(self.ends[-1][-1] + np.cumsum(sizes))

    def join(self, entries: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries, and where those of each text end."""
        if len(self.ids) > 1:
            self.ids, self.ends = [np.concatenate(self.ids)], [np.concatenate([e for e in self.ends if len(e)])]
        kept, bounds = self.ids[0], self.ends[0]
        tail = entries < 0
        number = np.where(tail, -1 - entries.astype(np.int64), 0)
        sizes = np.ones(len(entries), np.int64)
        sizes[tail] = (bounds[1:] - bounds[:-1])[number[tail]]
        stops = np.cumsum(sizes)
        out = np.repeat(entries, sizes)
        long = np.repeat(tail, sizes)
        first = np.repeat(np.where(tail, bounds[number], 0) - (stops - sizes), sizes)
        out[long] = kept[(first + np.arange(len(out)))[long]]
        return out, np.r_[0, stops][ends]


def _folded_once(docs: DataFrame, ranks: dict[bytes, int], table: dict[str, bytes], id_col: str, text_col: str) -> DataFrame:
    """Ids by table, and for words that it lacks by a fold a task and word.

    Rows go through one stage in their order: a row has the words that no row
    of its task had before, numbered on, and texts name words by number.
    """
    sent = docs.sparkSession.sparkContext.broadcast((ranks, table))
    rank_map, pieces = rank_map_of(ranks), byte_pieces(ranks)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = TailSplitter(*sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                entries, new, anew = splitter.split(batch.column(1).to_pylist())
                n = batch.num_rows
                words = pa.ListArray.from_arrays(pa.array([0] + [len(new)] * n, pa.int32()), spelled(new, pieces))
                yield pa.record_batch([batch.column(0), pa.array(entries, pa.binary()), words, pa.array([anew] + [False] * (n - 1))], names=["doc_id", "entries", "words", "anew"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = TailJoiner()
        for whole in batches:
            anew = np.flatnonzero(whole.column(3).to_numpy(zero_copy_only=False)).tolist()
            cuts = sorted({0, *range(0, whole.num_rows, BATCH), *anew})
            for at, to in zip(cuts, [*cuts[1:], whole.num_rows]):
                batch = whole.slice(at, to - at)
                folded = batch.column(2).flatten()
                joiner.add(folded.flatten().to_numpy(zero_copy_only=False).astype(np.int32), folded.value_lengths().to_numpy(zero_copy_only=False), at in anew)
                raw = batch.column(1).to_pylist()
                ids, ends = joiner.join(np.frombuffer(b"".join(raw), "<i4"), np.cumsum([0, *(len(x) // 4 for x in raw)]))
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = text_map(rows, split, "doc_id long, entries binary, words array<array<int>>, anew boolean")
    folds = _bound(rank_map.constants[:2], lambda *t: F.transform("words", lambda w: rank_map.fold_spelled(w, *t))).cast("array<array<int>>")
    return text_map(named.select("doc_id", "entries", folds.alias("folded"), "anew"), put, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with a column ``decoded``, the bytes of its ids."""
    by_id = {r: t for t, r in ranks.items()}
    pieces = _literal([by_id[i].hex() if i in by_id else None for i in range(max(by_id) + 1)], "array<string>")
    joined = _bound([pieces], lambda p: F.array_join(F.transform("ids", lambda i: F.get(p, i)), ""))
    return encoded.withColumn("decoded", F.unhex(joined))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", tail: str = "distinct", table_size: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256.

    One row per input row.  Null and empty texts have no ids and the hashes of
    the empty string; an empty table gives an empty table; repeated rows come
    out repeated; other columns are not read, whatever their names.  A smaller
    table takes less of the driver's memory and more time, with the same ids.
    """
    decimals = _literal([str(i) for i in range(max(ranks.values()) + 1)], "array<string>")
    ids = _bound([decimals], lambda d: F.array_join(F.transform("ids", lambda i: F.get(d, i)), " "))
    return decode(encode(docs, ranks, id_col, text_col, tail, table_size), ranks).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
