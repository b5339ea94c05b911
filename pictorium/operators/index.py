"""A stored search index that grows by segments and is read block by block.

*Blocks.*  A row holds the postings of one term in one *bucket* of neighbouring ids (``id >> BITS``): ids, weights, the largest weight and
the newest creation time.  All terms share the buckets, so the largest weights of a query's terms in a bucket add up to a
bound for every asset in it.  Blocks are sorted by (term, bucket) and stored in small row groups: a query reads the pages of its terms, first
without the postings.
*Segments.*  A segment is never changed.  A change adds a segment with the new postings and a list of the ids whose older postings are
dead (*tombstones*), so it writes about what changed.  Segments have rising numbers; a posting is dead if a tombstone of its id has a higher
number.  Neighbouring young segments of like size are merged into one (``merge``), so there are few, and each posting is rewritten
about log(postings) times.
*Versions.*  A manifest lists the segments of a version.  It is created under the next free number and never overwritten, so a version
appears at once, writers that race notice it, and readers keep the version they opened: files of older ones stay until ``vacuum``.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pictorium.functions.segment import Dictionary
from pictorium.functions.text import query_tokens
from pictorium.plans.scratch import Scratch

from .catalog import asset_predicate
from .search import WIDE, build_index, ranked

#: Ids of a bucket: 2^BITS.
BITS = 12
#: Segments of like size that are merged, and the size (postings) of the smallest tier.
FAN = 4
SMALLEST = 1_000_000
#: Buckets read in one wave of a search; then all that can still matter.
WAVES = (8, 64, 512)
ROW_GROUP_BYTES = 8 << 20
_POSTINGS = ["ids", "weights"]


class Index(NamedTuple):
    """One version of an index: segments oldest first, each ``{path, number, postings}``; tombstones ``{path, number}``."""

    path: str
    version: int
    bits: int
    segments: tuple[dict, ...]
    tombstones: tuple[dict, ...]


class Conflict(RuntimeError):
    """Another writer has committed the next version."""


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _file_system(spark, f"{path}/manifest")
    if not fs.exists(folder):
        return []
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json"))


def _commit(spark: SparkSession, index: Index) -> Index:
    """Writes the manifest of the next version."""
    new = index._replace(version=index.version + 1)
    text = json.dumps(new._asdict())
    fs, target = _file_system(spark, f"{new.path}/manifest/{new.version:09d}.json")
    try:
        out = fs.create(target, False)
    except Exception as error:
        if fs.exists(target):
            raise Conflict(f"version {new.version} of {new.path} exists") from error
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return new


def open_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The given or the newest version."""
    known = _versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no such version of an index in {path}")
    chosen = known[-1] if version is None else version
    raw = json.loads(spark.read.text(f"{path}/manifest/{chosen:09d}.json", wholetext=True).head()[0])
    return Index(path, chosen, raw["bits"], tuple(raw["segments"]), tuple(raw["tombstones"]))


def _bucket(ids: Column, bits: int) -> Column:
    return F.shiftright(ids, bits)


def _write_blocks(spark: SparkSession, postings: DataFrame, path: str, bits: int) -> int:
    """Blocks of ``(image_id, term, weight, newest)``, sorted by term and bucket; gives the number of postings.  Blocks are
    grouped once, stored, and dealt by ranges of the stored rows, so nothing is tokenised twice."""
    scratch = Scratch(spark, "index")
    pairs = F.array_sort(F.collect_list(F.struct("image_id", "weight")))
    keyed = postings.withColumn("bucket", _bucket(F.col("image_id"), bits))
    grouped = keyed.groupBy("term", "bucket").agg(pairs.alias("p"), F.max("weight").alias("top"), F.max("newest").alias("newest"))
    blocks, seen = scratch.write(
        grouped.select("term", "bucket", F.size("p").alias("n"), "top", "newest", F.col("p.image_id").alias("ids"), F.col("p.weight").alias("weights")),
        postings=F.coalesce(F.sum("n"), F.lit(0)),
    )
    dealt = blocks.repartitionByRange("term", "bucket").sortWithinPartitions("term", "bucket")
    dealt.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    scratch.close()
    return seen["postings"]


def _fresh(assets: DataFrame, words) -> DataFrame:
    return build_index(assets, words, ("created_at",)).withColumnRenamed("created_at", "newest")


def create_index(assets: DataFrame, path: str, words: Dictionary | Iterable[str] | None = None, bits: int = BITS) -> Index:
    """A new index of all assets but rejected ones."""
    spark = assets.sparkSession
    if _versions(spark, path):
        raise Conflict(f"there is an index in {path}")
    return _added(spark, Index(path, 0, bits, (), ()), _fresh(assets, words), None)


def update_index(index: Index, changed: DataFrame, words: Dictionary | Iterable[str] | None = None) -> Index:
    """Replaces the postings of changed assets; rejected ones only lose theirs."""
    return _added(changed.sparkSession, index, _fresh(changed, words), changed.select(F.col("id").alias("image_id")))


def remove_from_index(index: Index, gone: DataFrame) -> Index:
    """Drops the postings of ``gone(id)``."""
    return _added(gone.sparkSession, index, None, gone.select(F.col("id").alias("image_id")))


def _added(spark: SparkSession, index: Index, postings: DataFrame | None, dead: DataFrame | None) -> Index:
    number = 1 + max([s["number"] for s in (*index.segments, *index.tombstones)], default=0)
    name = f"{number:09d}-{uuid.uuid4().hex[:12]}"
    segments, tombstones = index.segments, index.tombstones
    if dead is not None and segments:
        at = f"{index.path}/dead/{name}"
        rows = dead.filter(F.col("image_id").isNotNull()).distinct().withColumn("bucket", _bucket(F.col("image_id"), index.bits))
        rows.sortWithinPartitions("image_id").write.parquet(at)
        tombstones += ({"path": at, "number": number},)
    if postings is not None:
        at = f"{index.path}/segments/{name}"
        n = _write_blocks(spark, postings, at, index.bits)
        segments += ({"path": at, "number": number, "postings": n},)
    return _commit(spark, index._replace(segments=segments, tombstones=tombstones))


def _numbered(spark: SparkSession, parts: Iterable[dict]) -> DataFrame | None:
    """Segments (or tombstones) as one frame with their number; there are few, by merging."""
    frame = None
    for part in parts:
        rows = spark.read.parquet(part["path"]).withColumn("number", F.lit(part["number"]).cast("long"))
        frame = rows if frame is None else frame.unionByName(rows)
    return frame


def _postings_of(spark: SparkSession, index: Index, blocks: DataFrame, buckets: list[int] | None = None) -> DataFrame:
    """Live postings ``(image_id, term, weight, newest, number)`` of some blocks; ``buckets`` prunes the tombstones."""
    pairs = F.explode(F.arrays_zip("ids", "weights"))
    rows = blocks.select("term", "newest", "number", pairs.alias("p")).select(F.col("p.ids").alias("image_id"), "term", F.col("p.weights").alias("weight"), "newest", "number")
    dead = _numbered(spark, index.tombstones)
    if dead is None:
        return rows
    if buckets is not None:
        dead = dead.filter(F.col("bucket").isin(buckets))
    last = dead.groupBy(F.col("image_id").alias("dead_id")).agg(F.max("number").alias("dead_number"))
    return rows.join(last, (F.col("image_id") == F.col("dead_id")) & (F.col("number") < F.col("dead_number")), "left_anti")


def live_postings(spark: SparkSession, index: Index) -> DataFrame:
    """All postings, as :func:`build_index` gives them."""
    rows = _postings_of(spark, index, _numbered(spark, index.segments))
    return rows.select("image_id", "term", "weight", F.lit("combined").alias("field"))


def _tier(postings: int, fan: int, smallest: int) -> int:
    return 0 if postings <= smallest else 1 + int(math.log(postings / smallest, fan))


def merge_candidates(index: Index, fan: int = FAN, smallest: int = SMALLEST) -> list[dict]:
    """The youngest neighbouring segments to merge: the run of ``fan`` or more up to some tier, smallest tier first."""
    tiers = [_tier(s["postings"], fan, smallest) for s in index.segments]
    for tier in sorted(set(tiers)):
        run = 0
        while run < len(tiers) and tiers[-1 - run] <= tier:
            run += 1
        if run >= fan:
            return list(index.segments[len(tiers) - run :])
    return []


def merge_index(spark: SparkSession, index: Index, fan: int = FAN, smallest: int = SMALLEST) -> Index:
    """One merge, if one is due.  Dead postings go; tombstones stay only where an older segment can hold what they bury."""
    chosen = merge_candidates(index, fan, smallest)
    if not chosen:
        return index
    number = chosen[-1]["number"]
    rest = tuple(s for s in index.segments if s not in chosen)
    at = f"{index.path}/segments/{number:09d}-{uuid.uuid4().hex[:12]}"
    rows = _postings_of(spark, index, _numbered(spark, chosen)).drop("number")
    n = _write_blocks(spark, rows, at, index.bits)
    oldest = min([s["number"] for s in rest] + [number])
    needed = tuple(t for t in index.tombstones if t["number"] > oldest)
    return _commit(spark, index._replace(segments=(*rest, {"path": at, "number": number, "postings": n}), tombstones=needed))


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes manifests older than the ``keep`` newest and the files only they name; gives the number of folders deleted."""
    known = _versions(spark, path)
    kept = [open_index(spark, path, v) for v in known[-keep:]]
    used = {p["path"] for i in kept for p in (*i.segments, *i.tombstones)}
    for v in known[:-keep]:
        fs, target = _file_system(spark, f"{path}/manifest/{v:09d}.json")
        fs.delete(target, False)
    # a folder numbered above the newest version kept may belong to a writer at work
    newest = max([p["number"] for i in kept for p in (*i.segments, *i.tombstones)], default=0)
    deleted = 0
    for kind in ("segments", "dead"):
        fs, folder = _file_system(spark, f"{path}/{kind}")
        for f in fs.listStatus(folder) if fs.exists(folder) else []:
            name = f.getPath().getName()
            if f"{path}/{kind}/{name}" not in used and int(name.split("-")[0]) <= newest:
                fs.delete(f.getPath(), True)
                deleted += 1
    return deleted


class Wave(NamedTuple):
    """What one wave of a search read: buckets (None: all that could still matter) and how many there were to choose from."""

    buckets: int | None
    left: int


def search_index(
    index: Index,
    assets: DataFrame,
    query: str,
    limit: int = 20,
    offset: int = 0,
    words: Dictionary | Iterable[str] | None = None,
    waves: tuple[int, ...] = WAVES,
    trace: list[Wave] | None = None,
    **filters,
) -> DataFrame:
    """The page that :func:`pictorium.operators.search.search` gives, from the blocks that can hold it.

    Buckets are taken by falling bound, newest first, in growing waves.  After each, buckets whose bound is below the last result of
    the page so far are out: a lower score, or the same score with fewer terms or older assets only.  The last wave reads all that is left.  A
    wave's buckets are a short list that reaches the scans of blocks, tombstones and assets."""
    spark = assets.sparkSession
    terms = query_tokens(spark, query, words)
    filters.setdefault("tag_mode", "substring")
    allowed = assets.filter((F.col("ai_status") == "completed") & asset_predicate(**filters)).select("id", "created_at")
    scratch = Scratch(spark, "search")
    asked = _numbered(spark, index.segments).filter(F.col("term").isin(terms))
    per_term = asked.groupBy("bucket", "term").agg(F.max("top").alias("top"), F.max("newest").alias("newest"))
    bounds = per_term.groupBy("bucket").agg(F.sum("top").alias("bound"), F.count(F.lit(1)).alias("terms"), F.max("newest").alias("newest"))
    bounds, seen = scratch.write(bounds, n=F.count(F.lit(1)))
    left, done, found, size = seen["n"], [], None, limit + offset
    for wave in (*waves, None):
        passing = bounds.filter(~F.col("bucket").isin(done)) if done else bounds
        if found is not None:
            last = found.orderBy(*ranked()).offset(size - 1).limit(1).head()
            if last is not None:
                passing = passing.filter(_may_enter(last, bounds.schema["newest"].dataType))
        if wave is None:
            chosen, blocks = None, asked.join(passing.select("bucket"), "bucket", "left_semi")
            if passing.isEmpty():
                break
            candidates = allowed
        else:
            chosen = [r["bucket"] for r in passing.orderBy(F.desc("bound"), F.desc_nulls_first("newest"), "bucket").limit(wave).collect()]
            if not chosen:
                break
            blocks = asked.filter(F.col("bucket").isin(chosen))
            candidates = allowed.filter(F.col("id").between(min(chosen) << index.bits, ((max(chosen) + 1) << index.bits) - 1))
        if trace is not None:
            trace.append(Wave(None if chosen is None else len(chosen), left))
        hits = _postings_of(spark, index, blocks, chosen).groupBy(F.col("image_id").alias("id"))
        hits = hits.agg(F.count(F.lit(1)).alias("match_count"), F.sum("weight").alias("relevance_score")).join(candidates, "id")
        rows = hits.select("id", "match_count", "relevance_score", "created_at")
        rows = rows if found is None else found.unionByName(rows)
        found, _ = scratch.write(rows.orderBy(*ranked()).limit(size))
        done += chosen or []
        left -= len(chosen or [])
        if chosen is None or not left:
            break
    if found is None:
        found = allowed.limit(0).select("id", F.lit(0).cast("long").alias("match_count"), F.lit(0.0).alias("relevance_score"), "created_at")
    best = found.orderBy(*ranked()).offset(offset).limit(limit) if offset else found.orderBy(*ranked()).limit(limit)
    return assets.select("id", *WIDE).join(best, "id").orderBy(*ranked()).limit(limit)


def _may_enter(last, time: T.DataType) -> Column:
    """Whether a bucket can hold an asset that ranks before the last result."""
    score, terms, newest = F.col("bound"), F.col("terms"), F.col("newest")
    newer = F.lit(True) if last["created_at"] is None else F.coalesce(newest >= F.lit(str(last["created_at"])).cast(time), F.lit(False))
    same = (score == last["relevance_score"]) & ((terms > last["match_count"]) | ((terms == last["match_count"]) & newer))
    return (score > last["relevance_score"]) | same
