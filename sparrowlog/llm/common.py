"""Helpers shared by the corpus operators: checkpoints, shingles, ordered chunks."""

from __future__ import annotations

import bisect
import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LONG_MIN = -(2**63)
SLICE = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none and all run in this process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="sparrowlog-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, what: str) -> str:
    """A new path for files in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Computes the rows once and cuts the lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``materialise`` as Parquet, for many narrow rows that are read more than once."""
    where = scratch(df.sparkSession, what)
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def discard(spark: SparkSession, where: str) -> None:
    """Removes a folder of ``scratch`` that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def among_least(h: Column, n: int | Column, wanted: int) -> Column:
    """Whether a signed 64-bit hash is among about the 4 ``wanted`` least of n: a threshold that lets few rows on, before the least are ordered."""
    n = n if isinstance(n, Column) else F.lit(n)
    return h.cast("double") <= F.lit(-(2.0**63)) + F.lit(2.0**64) / F.greatest(F.lit(1.0), n / F.lit(4.0 * wanted))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch, of SLICE rows at most, so that Python holds few texts at once."""
    rows = SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                if (out := f(whole.slice(at, rows))) is not None:
                    yield out

    return text_map(df, run, schema)


def text_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` over rows with long values: small batches, and memory goes back to the system after each task.

    A session with Spark's default of 10,000 rows a batch gets 2,000.  Unless
    ``run`` ``keeps`` what earlier tasks left by ``per_process``, it is let go.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps and "_sparrowlog_process" in sys.modules:
            sys.modules["_sparrowlog_process"].__dict__.clear()
        try:
            yield from run(batches)
        finally:
            trim_memory()

    return df.mapInArrow(tidy, schema)


def trim_memory() -> None:
    """Gives memory that is free in this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def release(spark: SparkSession) -> None:
    """Gives back what the driver no longer needs: frames that are gone in Python free their plans, shuffles and checkpoints in the JVM."""
    gc.collect()
    trim_memory()
    spark._jvm.System.gc()
    trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> None:
    """``trim_memory`` for the driver's JVM, where it can (JDK 17.0.9 or later on glibc): what compilers and codecs have freed outside the heap goes back to the system.

    The server's own class isn't exported, so its method is looked up in the interface.
    """
    java, gateway = spark._jvm.java.lang, spark.sparkContext._gateway
    parts = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    try:
        kinds, args = gateway.new_array(java.Class, len(parts)), gateway.new_array(java.Object, len(parts))
        values = (spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", gateway.new_array(java.Object, 0), gateway.new_array(java.String, 0))
        for i, (kind, value) in enumerate(zip(parts, values)):
            kinds[i], args[i] = java.Class.forName(kind), value
        java.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(java.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass


def release_executors(spark: SparkSession) -> None:
    """Has the executors collect garbage, so that the heap that earlier stages grew goes back to the system before Python workers need the memory.

    One task for each core, which is likely to reach every executor; nothing depends on it.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def per_process(kind: str, key: object, make: Callable[[], object]) -> object:
    """What ``make`` gave for this key, if it was the last of its kind in this worker process; else made anew."""
    store = sys.modules.setdefault("_sparrowlog_process", types.ModuleType("_sparrowlog_process")).__dict__
    if store.get(kind, (None,))[0] != key:
        store.pop(kind, None)
        store[kind] = (key, make())
    return store[kind][1]


def lower_ascii_words(text: str | None) -> list[bytes]:
    """Words between runs of the six ASCII white-space bytes, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; of all words if there are fewer."""
    words = lower_ascii_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    stops = (ends - 1)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))


# ---------------------------------------------------------------- ordered chunks


def order_splits(df: DataFrame, key: str, chunks: int) -> list[int]:
    """Largest keys of up to ``chunks`` ranges of about equal rows, falling; they are keys of real rows.

    The list goes to the driver: one number a chunk, and chunks follow the
    number of shuffle partitions.  Null keys count as the smallest long.
    """
    k = F.coalesce(F.col(key), F.lit(LONG_MIN))
    at = [i / chunks for i in range(1, chunks)] or [1.0]
    row = df.agg(F.max(k).alias("top"), F.percentile_approx(k, at, max(10_000, 20 * chunks)).alias("cuts")).first()
    if row.top is None:
        return []
    return sorted({row.top, *(row.cuts or [])}, reverse=True)


def chunk_of(splits: list[int], key: int) -> int:
    """The chunk of ``key``: chunk j holds splits[j + 1] < key <= splits[j]."""
    rising = splits[::-1]
    return len(splits) - 1 - bisect.bisect_left(rising, key)


def chunks_of(splits: list[int], keys: np.ndarray) -> np.ndarray:
    rising = np.array(splits[::-1], np.int64)
    return (len(splits) - 1 - np.searchsorted(rising, keys, side="left")).astype(np.int32)


def chunk_count(spark: SparkSession) -> int:
    """A few chunks for each shuffle partition, so that hashing deals them evenly."""
    return max(8, 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def keep_rows(docs: DataFrame, dropped: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows of ``dropped``; of the rows of ``repeated`` one each.

    Both name rows by (doc_id, digest), digest being ``row_digest`` of the text.
    Rows are told apart by id and text, so an id used twice does no harm.
    """
    i, d = fresh(docs, "keep_id__", "keep_digest__")
    named = docs.withColumn(i, F.coalesce(F.col(id_col), F.lit(LONG_MIN))).withColumn(d, row_digest(F.col(text_col)))

    def keys(x: DataFrame) -> DataFrame:
        return x.select(F.coalesce(F.col("doc_id"), F.lit(LONG_MIN)).alias(i), F.col("digest").alias(d))

    again = materialise(keys(repeated).distinct())
    gone = keys(dropped)
    if again.isEmpty():
        return named.join(gone, [i, d], "left_anti").select(*docs.columns)
    once = named.join(again, [i, d], "left_semi").dropDuplicates([i, d])
    return named.join(again, [i, d], "left_anti").unionByName(once).join(gone, [i, d], "left_anti").select(*docs.columns)


def row_digest(text):
    """128 bits of a text's SHA-256 as binary; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)
