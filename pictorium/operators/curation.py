"""Tag corrections, error patterns and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_frame, page, update_where

_EMPTY = "array<string>"


def tags_add(current: Column, tags: Column) -> Column:
    """Append what is not there yet; existing duplicates and order stay."""
    return F.concat(current, F.array_except(tags, current))


def tags_remove(current: Column, tags: Column) -> Column:
    return F.filter(current, lambda t: ~F.array_contains(tags, t))


def tags_replace(current: Column, tags: Column) -> Column:
    return tags


OPERATIONS = {"add": tags_add, "remove": tags_remove, "replace": tags_replace}


def batch_tag_correction(assets: DataFrame, ids, tags: list[str], operation: str) -> tuple[DataFrame, DataFrame]:
    """``(corrections, failed_ids)``: a correction row per known id, and the
    ids that are unknown."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}")
    if not tags and operation != "remove":
        raise ValueError("tags may only be empty when removing")
    wanted = ids.select("id").distinct() if isinstance(ids, DataFrame) else id_frame(assets, ids)
    given = F.array(*[F.lit(t) for t in tags]).cast(_EMPTY)
    current = F.coalesce("ai_tags", F.array().cast(_EMPTY))
    known = assets.select("id", current.alias("old_tags")).join(wanted, "id", "left_semi")
    corrections = known.select(
        F.col("id").alias("image_id"), "old_tags", OPERATIONS[operation](F.col("old_tags"), given).alias("new_tags")
    )
    return corrections, wanted.join(assets.select("id"), "id", "left_anti")


def correction_counts(corrections: DataFrame, failed: DataFrame) -> DataFrame:
    ok = corrections.select(F.lit(1).cast("long").alias("ok"), F.lit(0).cast("long").alias("bad"))
    bad = failed.select(F.lit(0).cast("long").alias("ok"), F.lit(1).cast("long").alias("bad"))
    return ok.unionByName(bad).agg(
        F.coalesce(F.sum("ok"), F.lit(0)).cast("long").alias("success_count"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("failed_count"),
    )


def apply_corrections(assets: DataFrame, corrections: DataFrame) -> DataFrame:
    return update_where(assets, corrections.select(F.col("image_id").alias("id"), F.col("new_tags").alias("ai_tags")), "id", ["ai_tags"])


def record_corrections(corrections: DataFrame, patterns: DataFrame, seen_at: Column) -> tuple[DataFrame, DataFrame]:
    """``(accepted corrections, patterns)``; a correction from nothing to
    nothing is refused, each other one bumps ``tag_correction_<id>``."""
    accepted = corrections.filter((F.size("old_tags") > 0) | (F.size("new_tags") > 0))
    events = accepted.select(F.concat(F.lit("tag_correction_"), F.col("image_id").cast("string")).alias("pattern_name"), seen_at.alias("ts"))
    return accepted, record_patterns(patterns, events)


def correction_history(corrections: DataFrame, image_id: int) -> DataFrame:
    return corrections.filter(F.col("image_id") == image_id).orderBy(F.desc("corrected_at"), F.desc("id"))


def all_corrections(corrections: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(corrections, [F.desc("corrected_at"), F.desc("id")], limit, offset)


def count_patterns(events: DataFrame) -> DataFrame:
    """``(pattern_name, ts)`` to counters."""
    return events.groupBy("pattern_name").agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )


def record_patterns(patterns: DataFrame, events: DataFrame) -> DataFrame:
    """Merge counters: counts add up, the earliest first and the latest last
    sighting stay."""
    columns = ["pattern_name", "occurrence_count", "first_seen", "last_seen"]
    both = patterns.select(*columns).unionByName(count_patterns(events))
    return both.groupBy("pattern_name").agg(
        F.sum("occurrence_count").alias("occurrence_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def top_patterns(patterns: DataFrame, limit: int = 50, min_count: int = 1) -> DataFrame:
    return page(patterns.filter(F.col("occurrence_count") >= min_count), [F.desc("occurrence_count"), F.col("pattern_name")], limit)


def high_frequency_patterns(patterns: DataFrame, min_count: int) -> DataFrame:
    return top_patterns(patterns, 20, min_count)


def pattern_exists(patterns: DataFrame, name: str) -> DataFrame:
    return patterns.filter(F.col("pattern_name") == name).limit(1).agg((F.count(F.lit(1)) > 0).alias("present"))


def delete_pattern(patterns: DataFrame, name: str) -> DataFrame:
    return patterns.filter(~F.col("pattern_name").eqNullSafe(name))


def list_settings(settings: DataFrame) -> DataFrame:
    return settings.select("key", "value").orderBy("key")
