"""Exact duplicates through an extendible-hash index on shared files.

DataFrame operations only.

1. *Entries.*  Every text gets a 64-bit key.  Rows are grouped by (key, text):
   the aggregation compares the texts byte by byte and starts on the map side,
   so copies of one text shrink to a row per task before the shuffle, however many
   there are.  An entry is (key, sha-256 of the text, keep_id, n) and carries no
   text any more: the texts move once.
2. *Directory.*  As in extendible hashing, a bucket is a prefix of the key.  A
   directory of ``2 ** depth`` slots points to buckets; a bucket with more than ``capacity`` entries
   is split by its next key bit, and the directory doubles when the split bucket was as
   deep as the directory.  Counts per slot come from the entries (one row per slot and task); only slots
   inside overfull buckets are counted again at the next doubling.
   The directory has about ``2 * entries / capacity`` slots.
3. *Shared files.*  Entries look their slot up in the directory and move to the owner
   task of their bucket, which writes them sorted by key to the
   shared folder.  Owners are dealt by a hash of the bucket.  Different texts with one key are entries of
   their own.  The index serves lookup only: which texts are equal is settled in step 1.
4. *Lookup.*  Documents meet the index by (key, sha-256).  Both sides are plain scans, so AQE can
   split the join of a key that holds a third of all documents.

Null counts as empty.  Of equal texts the largest doc_id stays; a null id stays only when its
group has no other.  Rows that repeat an id and its text are all returned, and
all of them are kept if that id is.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pictorium.plans.scratch import Scratch

from .common import OWN

CAPACITY = 200_000
#: Deepest directory; a bucket that is still overfull there stays so.  Even keys need about
#: log2(entries / capacity) + 4 bits.
MAX_DEPTH = 24

KEY, SHA, TEXT = OWN + "key", OWN + "sha", OWN + "text"


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def bits_of(key: Column) -> Column:
    """The key with its bits spread, so that prefixes divide keys evenly even if ``key`` is a weak hash."""
    return F.xxhash64(key)


def slot_of(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of the key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(entries: DataFrame, capacity: int = CAPACITY) -> tuple[int, list[tuple[int, int]]]:
    """Global depth and the buckets as (prefix, local depth), in key order.

    Doubling starts at the depth at which even keys would fit.  Each round asks for the number of
    entries below every bucket that is still overfull; a bucket of one key (a chain) cannot be split and stays."""
    total = entries.count()
    open_buckets, done = [(0, 0, total)], []
    while open_buckets:
        full = [(p, d) for p, d, n in open_buckets if n > capacity and d < MAX_DEPTH]
        done += [(p, d) for p, d, n in open_buckets if n <= capacity or d >= MAX_DEPTH]
        if not full:
            break
        # several doublings in one count: enough bits for the mean to fit
        bits = max(1, (max(n for _, _, n in open_buckets) // capacity).bit_length())
        deep = min(MAX_DEPTH, full[0][1] + bits)
        rows = entries
        if full[0][1]:
            prefixes = entries.sparkSession.createDataFrame([(p,) for p, _ in full], "prefix long")
            rows = entries.join(F.broadcast(prefixes), slot_of(F.col(KEY), full[0][1]) == F.col("prefix"), "left_semi")
        counted = rows.groupBy(slot_of(F.col(KEY), deep).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min(KEY).alias("a"), F.max(KEY).alias("b"))
        cells = {r["slot"]: (r["n"], r["a"] == r["b"]) for r in counted.collect()}
        open_buckets = []
        for p, d in full:
            open_buckets += _split(p, d, deep, cells, capacity, done)
    return max([1] + [d for _, d in done]), sorted(done, key=lambda x: x[0] << (MAX_DEPTH - x[1]))


def _split(prefix: int, depth: int, deep: int, cells: dict, capacity: int, done: list) -> list[tuple[int, int, int]]:
    """Split one bucket bit by bit down to ``deep``; what is still overfull there is returned."""
    level = {prefix: [c for c in cells if c >> (deep - depth) == prefix]}
    over = []
    while level:
        below: dict[int, list[int]] = {}
        for p, own in level.items():
            n = sum(cells[c][0] for c in own)
            if n <= capacity or (len(own) == 1 and cells[own[0]][1]):
                done.append((p, depth))
            elif depth == deep:
                over.append((p, depth, n))
            else:
                half = deep - depth - 1
                for bit in (0, 1):
                    below[2 * p + bit] = [c for c in own if c >> half == 2 * p + bit]
        level, depth = below, depth + 1
    return over


def directory_frame(entries: DataFrame, depth: int, buckets: list[tuple[int, int]]) -> DataFrame:
    """One row per slot of the directory: (slot, bucket).  Made on the executors from the buckets."""
    rows = [(p << (depth - d), 1 << (depth - d), i) for i, (p, d) in enumerate(buckets)]
    frame = entries.sparkSession.createDataFrame(rows or [(0, 1, 0)], "first long, slots long, bucket long")
    return frame.select(F.explode(F.sequence("first", F.col("first") + F.col("slots") - 1)).alias("slot"), "bucket")


def build_index(docs: DataFrame, scratch: Scratch, capacity: int = CAPACITY, key=text_key) -> DataFrame:
    """The index, read back from its shared files: bucket, key, sha, keep_id, n."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), bits_of(key(text)).alias(KEY), text.alias(TEXT))
    grouped = rows.groupBy(KEY, TEXT).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    entries, _ = scratch.write(grouped.select(KEY, F.sha2(TEXT, 256).alias(SHA), "keep_id", "n"))
    depth, buckets = build_directory(entries, capacity)
    slots = directory_frame(entries, depth, buckets)
    placed = entries.join(F.broadcast(slots), slot_of(F.col(KEY), depth) == F.col("slot")).drop("slot")
    owned = placed.repartition(max(1, min(len(buckets), 4096)), "bucket").sortWithinPartitions("bucket", KEY, SHA)
    return scratch.write(owned)[0]


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, key=text_key) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact-index")
    index = build_index(docs, scratch, capacity, key)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", bits_of(key(text)).alias(KEY), F.sha2(text, 256).alias(SHA))
    found = rows.join(index, [KEY, SHA])
    return found.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col(SHA).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, key=text_key) -> DataFrame:
    """One row of every text: of the rows with the kept id any one, whole.

    The place of a kept row names its id, key and digest, so no place is shared by the copies of a text."""
    scratch = Scratch(docs.sparkSession, "exact-index")
    index = build_index(docs, scratch, capacity, key)
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.struct("keep_id", F.col(KEY).alias("k"), F.col(SHA).alias("s"))
    keep = index.select(place.alias(OWN + "place"))
    own = F.struct(F.col("doc_id").alias("keep_id"), bits_of(key(text)).alias("k"), F.sha2(text, 256).alias("s"))
    rows = docs.withColumn(OWN + "place", own)
    kept = rows.join(keep, rows[OWN + "place"].eqNullSafe(keep[OWN + "place"]), "left_semi")
    # the join has sorted by place already: rows that repeat id and text are numbered without a shuffle
    nth = F.row_number().over(Window.partitionBy(OWN + "place").orderBy(OWN + "place"))
    return kept.withColumn(OWN + "nth", nth).filter(F.col(OWN + "nth") == 1).select(*docs.columns)
