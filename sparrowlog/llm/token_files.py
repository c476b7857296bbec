"""Token ids in binary files: shared zstandard dictionary, one frame a document.

A data set is a folder of ``part-NNNNN.tok`` files in ascending document
order with ``dictionary.zdict`` and ``manifest.json`` beside them.  A file is::

    b"TOKFRAM1", SHA-256 of the dictionary (32 bytes), bytes an id (1)
    the documents' zstandard frames, one after another
    index: doc ids (int64), null marks (uint8), offsets (uint64), token counts (uint32), each for all documents
    place of the index (uint64), number of documents (uint64), b"TOKFRAM1"

Each frame is compressed on its own with the dictionary, so a short document
is read alone by its offset.  Files are written under a name of the attempt
and renamed, and the same rows give the same bytes, so a task that runs again
after a lost executor does no harm.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import LONG_MIN, among_least, chunk_count, chunks_of, order_splits, per_process, text_map

MAGIC = b"TOKFRAM1"
HEAD = len(MAGIC) + 33
#: Documents, code points of each and bytes of the dictionary, of the sample it is trained on.
TRAIN_DOCS, TRAIN_CHARS, DICTIONARY_BYTES = 1_000, 20_000, 1 << 16
LEVEL = 3
#: Words whose ids a task keeps.
CACHED_WORDS = 1_500_000
#: Documents, and code points of them, that are encoded at once.
BATCH, BATCH_CHARS = 4_000, 14_000_000
#: Letters, numbers and white space below U+0250, where UNCOMMON characters are left out.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \xa0"
#: How byte-level BPE splits a text before merging, for these characters.
PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: All others; a text with any of them is encoded in one call.
UNCOMMON = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9fɐ-\U0010ffff]")


class WordEncoder:
    """Ids by the tokenizers library, which sees each word once while it is kept."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        state = json.loads(definition).get("pre_tokenizer") or {}
        self.by_word = state.get("type") == "ByteLevel" and not state.get("add_prefix_space") and not json.loads(definition).get("normalizer")
        self.split = re.compile(PATTERN).findall
        self.words: dict[str, bytes] = {}
        #: Whether an id's bytes begin with a space, which byte-level vocabularies write as U+0120.
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t[:1] == "\u0120"]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word; words of a space and letters are encoded many in a row, which split again as they were."""
        row = [w for w in words if w[0] == " " and w[1:].isalpha()]
        other = [w for w in words if not (w[0] == " " and w[1:].isalpha())]
        known = dict(zip(other, self._ids(other)))
        rows = [row[i : i + 256] for i in range(0, len(row), 256)]
        for part, e in zip(rows, self.tokenizer.encode_batch_fast(["".join(p) for p in rows], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            body, cuts = ids.tobytes(), [*(np.flatnonzero(self.spaced[ids]) * self.width).tolist(), self.width * len(ids)]
            if len(cuts) == len(part) + 1:
                known.update((w, body[a:z]) for w, a, z in zip(part, cuts, cuts[1:]))
            else:
                known.update(zip(part, self._ids(part)))
        return [known[w] for w in words]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text."""
        out: list = [None] * len(texts)
        split, whole = [], []
        for i, text in enumerate(texts):
            if self.by_word and not UNCOMMON.search(text or ""):
                split.append((i, self.split(text or "")))
            else:
                whole.append(i)
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        seen: set[str] = set()
        for _, words in split:
            seen.update(words)
        new = list(seen.difference(self.words))
        self.words.update(zip(new, self._word_ids(new)))
        get = {w: self.words[w] for w in seen}.__getitem__  # small, so that its look-ups stay in the processor's cache
        for i, words in split:
            out[i] = b"".join(map(get, words))
        for i, ids in zip(whole, self._ids([texts[i] or "" for i in whole])):
            out[i] = ids
        return out


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _put(uri: str, body: bytes) -> None:
    fs, path = _fs(uri)
    with fs.open_output_stream(path) as out:
        out.write(body)


def _get(uri: str) -> bytes:
    fs, path = _fs(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary of serialized id arrays; their plain bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _codec(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write(docs: DataFrame, where: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Writes the data set into the folder ``where`` and returns its manifest.

    Null and empty texts are a document of ``end_id`` alone; null ids come
    first, rows of equal ids follow one another by their frames.
    """
    spark = docs.sparkSession
    definition = open(tokenizer_file, encoding="utf-8").read()
    encoder = WordEncoder(definition)
    width, end = encoder.width, np.array([end_id], encoder.dtype).tobytes()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    h = F.xxhash64("doc_id")
    few = rows.select("doc_id").filter(among_least(h, docs.count(), TRAIN_DOCS))
    chosen = [r.doc_id for r in few.orderBy(h, "doc_id").limit(TRAIN_DOCS).collect() if r.doc_id is not None]
    sample = rows.filter(F.col("doc_id").isin(chosen)).select(h.alias("h"), F.substring("text", 1, TRAIN_CHARS).alias("text")).orderBy("h", "text").limit(TRAIN_DOCS)
    dictionary = train_dictionary([x + end for x in encoder.encode([r.text for r in sample.collect()])] if chosen else [])
    fs, path = _fs(where)
    fs.create_dir(path, recursive=True)
    _put(f"{where}/dictionary.zdict", dictionary)
    splits = order_splits(rows, "doc_id", chunk_count(spark))
    last = len(splits) - 1
    sent = spark.sparkContext.broadcast((definition, dictionary))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition, dictionary = sent.value
        encoder = per_process("token-files", definition, lambda: WordEncoder(definition))
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **_codec(dictionary))
        gc.disable()  # words and ids make no cycles, and there are many to trace
        try:
            for whole in _gathered(batches):
                for batch in _slices(whole):
                    ids = [x + end for x in encoder.encode(batch.column(1).to_pylist())]
                    chunk = last - chunks_of(splits, batch.column(0).fill_null(LONG_MIN).to_numpy(zero_copy_only=False))
                    yield pa.record_batch([batch.column(0), pa.array(chunk.astype(np.int32)), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(map(packer.compress, ids), pa.binary())], names=["doc_id", "chunk", "n", "frame"])
        finally:
            gc.enable()

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256(sent.value[1]).digest()
        done, open_file = [], None
        for batch in batches:
            for i, k, n, frame in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if open_file is None or open_file.chunk != k:
                    done += [open_file.close()] if open_file else []
                    open_file = _File(where, k, digest, width)
                open_file.add(i, n, frame)
        done += [open_file.close()] if open_file else []
        if done:
            yield pa.record_batch([pa.array(x) for x in zip(*done)], names=["chunk", "file", "n_docs", "n_tokens", "bytes"])

    framed = text_map(rows, frames, "doc_id long, chunk int, n long, frame binary", keeps=True).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk")
    parts = framed.sortWithinPartitions("chunk", F.col("doc_id").asc_nulls_first(), "frame").mapInArrow(files, "chunk long, file string, n_docs long, n_tokens long, bytes long")
    listed = sorted((r.asDict() for r in parts.collect()), key=lambda r: r["chunk"])
    start = 0
    for r in listed:
        r["start"] = start
        start += r["n_tokens"]
    manifest = {"format": MAGIC.decode(), "dictionary_sha256": hashlib.sha256(dictionary).hexdigest(), "bytes_an_id": width, "files": listed, "n_tokens": start}
    _put(f"{where}/manifest.json", json.dumps(manifest).encode())
    return manifest


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have BATCH rows or BATCH_CHARS bytes: words repeat more in many documents."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BATCH or sum(b.nbytes for b in held) >= BATCH_CHARS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch (doc_id, text) in parts of up to BATCH rows and about BATCH_CHARS bytes, one row at least."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        reach = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_CHARS, "right"))
        to = min(max(reach, at + 1), at + BATCH)
        yield batch.slice(at, to - at)
        at = to


class _File:
    def __init__(self, where: str, chunk: int, digest: bytes, width: int):
        self.where, self.chunk, self.name = where, chunk, f"part-{chunk:05d}.tok"
        self.fs, path = _fs(where)
        self.path, self.own = f"{path}/{self.name}", f"{path}/.{self.name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own)
        self.out.write(MAGIC + digest + bytes([width]))
        self.at, self.ids, self.offsets, self.counts = HEAD, [], [], []

    def add(self, doc_id: int | None, n: int, frame: bytes) -> None:
        self.out.write(frame)
        self.ids.append(doc_id)
        self.offsets.append(self.at)
        self.counts.append(n)
        self.at += len(frame)

    def close(self) -> tuple[int, str, int, int, int]:
        null = [i is None for i in self.ids]
        for values, kind in (([i or 0 for i in self.ids], "<i8"), (null, "u1"), (self.offsets, "<u8"), (self.counts, "<u4")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(struct.pack("<QQ", self.at, len(self.ids)) + MAGIC)
        size = self.out.tell()
        self.out.close()
        self.fs.move(self.own, self.path)
        return self.chunk, self.name, len(self.ids), sum(self.counts), size


class TokenFile:
    """One file, open for reading whole or by document."""

    def __init__(self, uri: str, dictionary: bytes):
        fs, path = _fs(uri)
        self.f = fs.open_input_file(path)
        self.f.seek(self.f.size() - 24)
        place, n, magic = struct.unpack("<QQ8s", self.f.read(24))
        self.f.seek(0)
        head = self.f.read(HEAD)
        if magic != MAGIC or head[:8] != MAGIC or head[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} is no token file of this dictionary")
        self.width = head[40]
        self.f.seek(place)
        index = self.f.read(21 * n)
        self.ids, self.null = np.frombuffer(index, "<i8", n), np.frombuffer(index, "u1", n, 8 * n)
        self.offsets, self.counts = np.frombuffer(index, "<u8", n, 9 * n), np.frombuffer(index, "<u4", n, 17 * n)
        self.ends = np.append(self.offsets[1:], np.uint64(place))
        self.unpacker = zstandard.ZstdDecompressor(**_codec(dictionary))

    def frames(self, block: int = 1 << 22) -> Iterator[np.ndarray]:
        """The ids of each document in order; reads blocks of many frames."""
        first = 0
        while first < len(self.ids):
            last = max(first + 1, int(np.searchsorted(self.ends, self.offsets[first] + np.uint64(block), "right")))
            base = int(self.offsets[first])
            self.f.seek(base)
            body = self.f.read(int(self.ends[last - 1]) - base)
            for i in range(first, last):
                yield self._ids(body[int(self.offsets[i]) - base : int(self.ends[i]) - base])
            first = last

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file alone."""
        self.f.seek(int(self.offsets[i]))
        return self._ids(self.f.read(int(self.ends[i] - self.offsets[i])))

    def _ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.unpacker.decompress(frame), "<u2" if self.width == 2 else "<u4").astype("<u4")


def read(spark: SparkSession, where: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids binary) of each document, from the files; ids little-endian uint32.

    Without ``with_ids`` the ids are read and summed up but not passed on: null.
    """
    manifest, dictionary = json.loads(_get(f"{where}/manifest.json")), _get(f"{where}/dictionary.zdict")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    listed = [(r["file"], r["start"]) for r in manifest["files"]]
    if not listed:
        return spark.createDataFrame([], schema)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(f"{where}/{name}", dictionary)
                held: list = []
                size = 0
                for i, ids in enumerate(file.frames()):
                    body = ids.tobytes()
                    held.append((None if file.null[i] else int(file.ids[i]), start, len(ids), zlib.crc32(body), body if with_ids else None))
                    start += len(ids)
                    size += len(body) * with_ids
                    if size > 1 << 24 or len(held) >= 5000:
                        yield _batch(held, schema)
                        held, size = [], 0
                if held:
                    yield _batch(held, schema)

    return spark.createDataFrame(listed, "file string, start long").repartition(min(len(listed), max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))).mapInArrow(documents, schema)


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array(x, types[t]) for x, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])
