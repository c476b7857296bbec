"""WARC fixity: Merkle trees over records and their ordered offset ranges, compared branch by branch.

Pages are written out as WARC records in order of id; a record's place is the
sum of the sizes before it.  Ids are numbered by rank, and an id that only the
replica has shares the number of the id before it, so that both trees have a
leaf for each number and log(n) levels whatever the ids are.  A leaf hashes its
records' bytes and sizes and the gap before each: how far its range begins from
where the one before it ends.  (Gaps, and not offsets, so that one lost record
doesn't make all later ones differ.)  A node hashes the nodes of FANOUT
neighbouring numbers in order.  Two replicas are compared from the root: only
the children of nodes that differ are looked at further, down to the records
that are damaged, moved, missing or added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import LONG_MIN, materialise

FANOUT = 16
#: Nodes a partition of a tree's level holds, about.
PART_NODES = 100_000
#: Fixed value: the date in each header; the tables hold none.
RECORD_DATE = "2024-01-01T00:00:00Z"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of one WARC 1.1 resource record; null columns count as empty."""
    body = F.coalesce(html.cast("string"), F.lit(""))
    at = F.coalesce(url.cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), at).cast("binary"))
    uuid = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), at,
        F.lit(f"\r\nWARC-Date: {RECORD_DATE}\r\nWARC-Record-ID: <urn:uuid:"), uuid,
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def records(pages: DataFrame, offset: Column | None = None) -> DataFrame:
    """(page_id, length, digest binary): size and SHA-256 of each page's record; with ``offset`` also that."""
    r = record(F.col("page_id"), F.col("url"), F.col("html"))
    more = [] if offset is None else [offset.cast("long").alias("offset")]
    made = pages.select(F.col("page_id").cast("long").alias("page_id"), r.alias("r"), *more)
    return made.select("page_id", F.octet_length("r").cast("long").alias("length"), F.unhex(F.sha2("r", 256)).alias("digest"), *(["offset"] if more else []))


def _ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with a column ``chunk``: rows of a lower chunk come before those of a higher one. Checkpointed, so that the chunks stay what they are."""
    chunks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(chunks, *order).withColumn("chunk", F.spark_partition_id()))


def _running(ranged: DataFrame, value: str, total: str, order: list) -> DataFrame:
    """``ranged`` with ``total``: the sum of ``value`` over all rows before this one. One row a chunk goes to the driver."""
    sums, before, bases = sorted(ranged.groupBy("chunk").agg(F.sum(value).cast("long").alias("n")).collect()), 0, []
    for r in sums:
        bases.append((r.chunk, before))
        before += r.n
    base = ranged.sparkSession.createDataFrame(bases, "chunk int, base long")
    inside = F.sum(value).over(Window.partitionBy("chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)
    return ranged.withColumn(total, inside).join(F.broadcast(base), "chunk").withColumn(total, F.col(total) + F.col("base")).drop("chunk", "base")


def _by_id() -> list[Column]:
    return [F.col("page_id").asc_nulls_first(), F.col("digest").asc()]


def placed(found: DataFrame) -> DataFrame:
    """``records`` with their offsets in order of (page_id, digest), null ids first, and no gap before any."""
    return _running(_ranged(found, *_by_id()), "length", "offset", _by_id()).withColumn("gap", F.lit(0).cast("long"))


def located(found: DataFrame) -> DataFrame:
    """``records`` that have an ``offset`` of their own, with the gap before each in order of (page_id, digest); the first's is its offset."""
    ranged = _ranged(found, *_by_id())
    stop = F.col("offset") + F.col("length")
    last = Window.orderBy("chunk")
    ends = ranged.groupBy("chunk").agg(F.max_by(stop, F.struct(F.coalesce("page_id", F.lit(LONG_MIN)), "digest")).alias("stop"))
    ends = ends.withColumn("before", F.lag("stop", 1, 0).over(last)).select("chunk", "before")  # one row a chunk
    previous = F.coalesce(F.lag(stop).over(Window.partitionBy("chunk").orderBy(*_by_id())), "before")
    return ranged.join(F.broadcast(ends), "chunk").withColumn("gap", F.coalesce(F.col("offset") - previous, F.lit(LONG_MIN))).drop("chunk", "before")


def _sum_hash(digest: Column) -> Column:
    """An aggregate: a hash of any number of SHA-256 digests (binary), in no order, that is made piece by piece."""
    words = [F.conv(F.substring(F.hex(digest), 1 + 15 * i, 15), 16, 10).cast("long") for i in range(4)]
    combined = [f(w) for w in words for f in (F.bit_xor, lambda w: F.sum(w.cast("decimal(38,0)")))]
    return F.unhex(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *(c.cast("string") for c in combined)).cast("binary"), 256))


def by_id(found: DataFrame) -> DataFrame:
    """One row an id: (key, body, range_hash, start, stop, n, gapped). Null ids are the key LONG_MIN."""
    own = F.unhex(F.sha2(F.concat_ws(":", F.hex("digest"), F.col("length").cast("string"), F.col("gap").cast("string")).cast("binary"), 256))
    keyed = found.withColumn("key", F.coalesce("page_id", F.lit(LONG_MIN))).withColumn("own", own)
    stop = F.max(F.col("offset") + F.col("length"))
    return keyed.groupBy("key").agg(_sum_hash(F.col("digest")).alias("body"), _sum_hash(F.col("own")).alias("range_hash"), F.min("offset").alias("start"), stop.alias("stop"), F.count("*").alias("n"), F.max(F.col("gap") != 0).alias("gapped"))


def numbered(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(key, slot): the rank of each id of ours from 0; ids of theirs alone have that of the id before (0 if there is none)."""
    keys = ours.select("key", F.lit(1).cast("long").alias("mine")).unionByName(theirs.select("key", F.lit(0).cast("long").alias("mine"))).groupBy("key").agg(F.max("mine").alias("mine"))
    ranks = _running(_ranged(keys, "key"), "mine", "before", ["key"])
    return ranks.select("key", F.greatest(F.col("before") + F.col("mine") - 1, F.lit(0)).alias("slot"))


def _parts(top: int) -> int:
    """Partitions of a level of nodes 0 to ``top``: a high level needs few, however many shuffle partitions there are."""
    return max(1, -(-(top + 1) // PART_NODES))


def _parent(node: Column) -> Column:
    return F.shiftright(node, FANOUT.bit_length() - 1)


def tree(slotted: DataFrame) -> list[DataFrame]:
    """Levels (node, hash, n, start, stop) from the leaves, one a slot, to the top node.

    A leaf's hash is over the ids of its slot (one, and those that only the
    replica has), a node's over its children in order, of which there are at most FANOUT.
    """
    one = F.unhex(F.sha2(F.concat_ws(":", F.col("key").cast("string"), F.hex("range_hash")).cast("binary"), 256))
    leaf = slotted.withColumn("one", one).groupBy(F.col("slot").alias("node")).agg(_sum_hash(F.col("one")).alias("hash"), F.sum("n").alias("n"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    levels = [materialise(leaf)]
    while True:
        edge = levels[-1].agg(F.min("node").alias("a"), F.max("node").alias("z")).first()
        if edge.a is None or edge.a == edge.z:
            return levels
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))
        up = levels[-1].groupBy(_parent(F.col("node")).alias("parent")).agg(children.alias("c"), F.sum("n").alias("n"), F.min("start").alias("start"), F.max("stop").alias("stop"))
        joined = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x.node.cast("string"), F.hex(x.hash))), ",")
        level = up.select(F.col("parent").alias("node"), F.unhex(F.sha2(joined.cast("binary"), 256)).alias("hash"), "n", "start", "stop")
        levels.append(materialise(level.coalesce(_parts(edge.z // FANOUT))))


def differing(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(slot) of leaves that differ.

    Goes down from the top, at each level only below the nodes that differ.
    """
    for tall, low in ((ours, theirs), (theirs, ours)):
        while len(low) < len(tall):  # a replica of few slots has fewer levels
            low.append(materialise(low[-1].select(_parent(F.col("node")).alias("node"), "hash", "n", "start", "stop")))
    wrong = None
    for depth, (a, b) in enumerate(zip(reversed(ours), reversed(theirs))):
        a, b = a.select("node", F.col("hash").alias("a")), b.select("node", F.col("hash").alias("b"))
        if wrong is not None:
            a, b = (x.join(wrong, _parent(x.node) == wrong.parent, "left_semi") for x in (a, b))
        differ = a.join(b, "node", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
        at = materialise(differ.coalesce(_parts(FANOUT**depth)))
        wrong = at.select(F.col("node").alias("parent"))
    return at.select(F.col("node").alias("slot"))


def audit(pages: DataFrame, replica: DataFrame, replica_offset: str | None = None) -> DataFrame:
    """One row for each record of ``pages`` and each id only ``replica`` has.

    Columns: page_id, offset, length, record_sha256, status: intact, damaged,
    moved, missing or added (added ids have no offset, length or hash).
    ``replica_offset`` names the replica's column that says where each record
    lies; without it, its records lie one after another in order of ids.
    Moved: whole, but neither right after the record before it nor at its own
    place.  Rows that share an id share its status.  Null ids are one id,
    before all others.  Empty tables, null columns and very long pages do no
    harm; other columns are not read, whatever their names.
    """
    mine = materialise(placed(records(pages)))
    if replica_offset is None:
        theirs = placed(records(replica))
    else:
        theirs = located(records(replica, F.col(replica_offset)))
    a, b = (materialise(by_id(x)) for x in (mine, theirs))
    slots = materialise(numbered(a, b))
    ours, others = a.join(slots, "key"), b.join(slots, "key")
    wrong = differing(tree(ours), tree(others))
    x, y = (side.join(wrong, "slot", "left_semi").select("key", F.col("body").alias(f"{c}_body"), F.col("start").alias(f"{c}_start"), F.col("gapped").alias(f"{c}_gapped")) for side, c in ((ours, "a"), (others, "b")))
    moved = F.col("b_gapped") & ~F.col("a_start").eqNullSafe(F.col("b_start"))
    status = F.when(F.col("b_body").isNull(), "missing").when(F.col("a_body").isNull(), "added").when(F.col("a_body") != F.col("b_body"), "damaged").when(moved, "moved").otherwise("intact")
    found = materialise(x.join(y, "key", "full_outer").select("key", status.alias("status")).filter("status <> 'intact'"))
    key = F.coalesce("page_id", F.lit(LONG_MIN))
    out = mine.withColumn("key", key).join(found, "key", "left").select("page_id", "offset", "length", F.lower(F.hex("digest")).alias("record_sha256"), F.coalesce("status", F.lit("intact")).alias("status"))
    real = F.when(F.col("key") != LONG_MIN, F.col("key"))
    added = found.filter("status = 'added'").select(real.alias("page_id"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("string").alias("record_sha256"), "status")
    return out.unionByName(added)
