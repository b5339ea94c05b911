"""Catalog queries: paging, filters, facets, work lists, defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictorium.functions import fixed_values as V
from pictorium.functions.text import contains_ci

from .common import only_ids, page, without_ids
from .substring_index import find_containing


def asset_predicate(
    status: str | None = None,
    category: str | None = None,
    tags: list[str] | None = None,
    start=None,
    end=None,
    tag_mode: str = "exact",
) -> Column:
    """Conjunction of the given filters.  Date bounds are inclusive instants,
    so an ``end`` given as a date means its midnight (see :func:`end_of_day`)."""
    parts = [F.lit(True)]
    if status is not None:
        parts.append(F.col("ai_status") == status)
    if category is not None:
        parts.append(F.col("ai_category") == category)
    if tags:
        parts.append(has_tags(F.col("ai_tags"), tags, tag_mode))
    if start is not None:
        parts.append(F.col("created_at") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        parts.append(F.col("created_at") <= F.lit(end).cast("timestamp_ntz"))
    return reduce(lambda a, b: a & b, parts)


def end_of_day(date: str) -> str:
    return f"{date} 23:59:59.999999"


def has_tags(column: Column, tags: list[str], mode: str = "exact") -> Column:
    """Every tag must match: as a whole element, or anywhere in the list text."""
    if mode == "exact":
        each = [F.array_contains(column, t) for t in tags]
    else:
        each = [contains_ci(F.to_json(column), t) for t in tags]
    return reduce(lambda a, b: a & b, each)


def filter_by_tags(df: DataFrame, tags: list[str], mode: str = "exact") -> DataFrame:
    return df.filter(has_tags(F.col("ai_tags"), tags, mode))


def newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("id")]


def list_assets(df: DataFrame, page_no: int = 1, size: int = 50, **filters) -> DataFrame:
    """One page (1-based), newest first."""
    shown = df.filter(asset_predicate(**filters))
    if "generation_source" in df.columns:
        shown = shown.withColumn("generation_source", F.coalesce("generation_source", F.lit("manual_import")))
    return page(shown, newest_first(), size, max(page_no - 1, 0) * size)


def count_assets(df: DataFrame, **filters) -> DataFrame:
    return df.filter(asset_predicate(**filters)).agg(F.count(F.lit(1)).alias("total"))


def get_by_id(df: DataFrame, key, column: str = "id", required: bool = False) -> DataFrame:
    found = df.filter(F.col(column) == key)
    if required and found.isEmpty():
        raise LookupError(f"no row with {column} = {key!r}")
    return found


def parse_filter(text: str | None) -> Column:
    """``category:X`` or ``date:Y`` (from that moment on); anything else: all."""
    if text and "category:" in text:
        return F.col("ai_category") == text.split("category:")[1]
    if text and "date:" in text:
        return F.col("created_at") >= F.lit(text.split("date:")[1]).cast("timestamp_ntz")
    return F.lit(True)


def list_with_filter(df: DataFrame, text: str | None, page_no: int = 1, size: int = 20) -> DataFrame:
    columns = ["id", "file_name", "file_path", "ai_category", "created_at"]
    return page(df.filter(parse_filter(text)).select(*columns), newest_first(), size, max(page_no - 1, 0) * size)


def count_with_filter(df: DataFrame, text: str | None) -> DataFrame:
    return df.filter(parse_filter(text)).agg(F.count(F.lit(1)).alias("total"))


def _keyword_fields() -> list[Column]:
    return [F.array_join("ai_tags", ","), F.col("ai_description"), F.col("file_name")]


def _keyword_hit(words: list[str], category: str | None) -> Column:
    hit = reduce(lambda a, b: a | b, [F.coalesce(contains_ci(f, w), F.lit(False)) for w in words for f in _keyword_fields()])
    return hit if category is None else hit & (F.col("ai_category") == category)


def keyword_search(df: DataFrame, query: str, category: str | None = None, limit: int = 20) -> DataFrame:
    """Any word in tags, description or file name; the category binds to all
    words."""
    words = [w for w in query.split(" ") if w]
    if not words:
        return df.limit(0)
    return page(df.filter(_keyword_hit(words, category)), newest_first(), limit)


def keyword_texts(df: DataFrame) -> DataFrame:
    """``(id, text)``: what :func:`keyword_search` looks through, for :func:`substring_index.append_texts`."""
    return df.select("id", F.concat_ws("\n", *_keyword_fields()).alias("text"))


def indexed_keyword_search(df: DataFrame, path: str, query: str, category: str | None = None, limit: int = 20, trace: list[int] | None = None) -> DataFrame:
    """:func:`keyword_search` by a stored substring index of :func:`keyword_texts`."""
    words = [w for w in query.split(" ") if w]
    if not words:
        return df.limit(0)
    return page(find_containing(df, path, words, _keyword_hit(words, category), trace=trace), newest_first(), limit)


def facet_categories(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ai_category").isNotNull()).select("ai_category").distinct().orderBy("ai_category")


def facet_tags(df: DataFrame) -> DataFrame:
    return df.select(F.explode("ai_tags").alias("tag")).distinct().orderBy("tag")


def recent_results(df: DataFrame, limit: int = 50) -> DataFrame:
    done = df.filter(F.col("ai_status").isin("completed", "failed") & F.col("ai_processed_at").isNotNull())
    return page(done, [F.desc("ai_processed_at"), F.desc("id")], limit)


def pending_work(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ai_status") == "pending").select("id", "file_path", "ai_retry_count", "created_at").orderBy("created_at", "id")


def retryable_work(df: DataFrame, max_attempts: int = V.MAX_ATTEMPTS) -> DataFrame:
    again = (F.col("ai_status") == "failed") & (F.col("ai_retry_count") < max_attempts)
    return df.filter(again).select("id", "file_path", "ai_retry_count")


def eligible_batch(df: DataFrame, ids) -> DataFrame:
    return only_ids(df.filter(F.col("ai_status").isin("pending", "failed")), ids)


def batch_target(df: DataFrame, target: str = "pending") -> DataFrame:
    """``all``, ``pending`` or ``failed`` rows for a tagging run."""
    if target == "all":
        return df
    if target not in ("pending", "failed"):
        raise ValueError(f"unknown target {target!r}")
    return df.filter(F.col("ai_status") == target)


def count_by_source(df: DataFrame, source: str) -> DataFrame:
    return df.filter(F.col("source") == source).agg(F.count(F.lit(1)).alias("n"))


def delete_by_source(assets: DataFrame, postings: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    gone = assets.filter(F.col("source") == source).select("id")
    kept = assets.filter(~F.col("source").eqNullSafe(source))
    return kept, without_ids(postings, gone, "image_id")


def with_defaults(df: DataFrame) -> DataFrame:
    """NULL to the value shown for it."""
    texts = {c: "" for c in ("ai_description", "ai_category", "ai_error_message") if c in df.columns}
    out = df.na.fill({**texts, **({"ai_confidence": 0.0} if "ai_confidence" in df.columns else {})})
    if "ai_tags" in df.columns:
        out = out.withColumn("ai_tags", F.coalesce("ai_tags", F.array().cast("array<string>")))
    for name, value in (
        ("ai_status", "pending"),
        ("ai_tag_status", "provisional"),
        ("ai_provider", "lm_studio"),
        ("generation_source", "manual_import"),
        ("source", "import"),
    ):
        if name in df.columns:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out
