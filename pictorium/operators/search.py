"""Inverted-index search.

Postings are rows ``(image_id, term, field, weight)``, unique per (image,
term), which building and refreshing preserve; :func:`write_index` stores them sorted by term so that a query's terms
skip row groups.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pictorium.functions.segment import Dictionary
from pictorium.functions.text import contains_ci, query_tokens, tokenize

from .catalog import asset_predicate
from .common import page, without_ids
from .substring_index import find_containing

WIDE = ["file_path", "file_name", "ai_description", "ai_category", "ai_confidence"]


def index_terms(assets: DataFrame, words: Dictionary | Iterable[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(image_id, term, weight)`` of every asset: description and category
    tokens, lower-cased tags, and the tokens of ``id <n>``.  One map stage; no
    shuffle, as duplicates are removed inside the row.  ``keep`` names further columns to carry along."""
    tags = F.transform(F.coalesce("ai_tags", F.array().cast("array<string>")), F.lower)
    empty = F.lit("")
    terms = F.array_distinct(
        F.concat(
            tokenize(F.coalesce("ai_description", empty), words),
            tags,
            tokenize(F.coalesce("ai_category", empty), words),
            tokenize(F.concat(F.lit("id "), F.col("id").cast("string")), words),
        )
    )
    exploded = assets.select(F.col("id").alias("image_id"), *keep, tags.alias("tags"), F.explode(terms).alias("term"))
    weight = F.when(F.array_contains("tags", F.col("term")), F.lit(2.0)).otherwise(F.lit(1.0))
    return exploded.select("image_id", "term", weight.alias("weight"), *keep)


def build_index(assets: DataFrame, words: Dictionary | Iterable[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Postings of all assets but rejected ones."""
    shown = assets.filter(~F.col("ai_tag_status").eqNullSafe("rejected"))
    return index_terms(shown, words, keep).withColumn("field", F.lit("combined"))


def write_index(postings: DataFrame, path: str) -> None:
    """Range-partitioned and sorted by term (then image, which spreads a term
    held by a third of all assets over many files)."""
    postings.repartitionByRange("term", "image_id").sortWithinPartitions("term", "image_id").write.mode(
        "overwrite"
    ).parquet(path)


def refresh_index(postings: DataFrame, changed: DataFrame, words: Dictionary | Iterable[str] | None = None) -> DataFrame:
    """Replace the postings of changed assets; rejected ones only lose theirs."""
    fresh = build_index(changed, words)
    return drop_index(postings, changed.select("id")).unionByName(fresh.select(*postings.columns))


def drop_index(postings: DataFrame, ids) -> DataFrame:
    return without_ids(postings, ids, "image_id")


def ranked() -> list[Column]:
    """The order of search results."""
    return [F.desc("relevance_score"), F.desc("match_count"), F.desc("created_at"), F.desc("id")]


def _scores(matches: DataFrame, keys: list[str]) -> DataFrame:
    # postings are unique per (image, term), so rows are distinct terms
    return matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("match_count"), F.sum("weight").alias("relevance_score"))


def search(
    postings: DataFrame,
    assets: DataFrame,
    query: str,
    limit: int = 20,
    offset: int = 0,
    words: Dictionary | Iterable[str] | None = None,
    **filters,
) -> DataFrame:
    """Best assets for one query string.

    Ranking runs on (id, created_at) only, so descriptions never enter a
    shuffle.  The page found meets the wide columns in a join that AQE plans from
    its true size: a short page is broadcast, a long one is not.
    """
    spark = assets.sparkSession
    terms = query_tokens(spark, query, words)
    filters.setdefault("tag_mode", "substring")
    allowed = assets.filter((F.col("ai_status") == "completed") & asset_predicate(**filters))
    hits = _scores(postings.filter(F.col("term").isin(terms)), ["image_id"]).withColumnRenamed("image_id", "id")
    best = page(hits.join(allowed.select("id", "created_at"), "id"), ranked(), limit, offset)
    wide = assets.select("id", *WIDE)
    # a limit makes the final order a top-k: no range shuffle, no sampling job
    return wide.join(best, "id").orderBy(*ranked()).limit(limit)


def search_many(
    postings: DataFrame, assets: DataFrame, queries: DataFrame, k: int = 20, words: Dictionary | Iterable[str] | None = None
) -> DataFrame:
    """Batch form: ``queries(query_id, query)`` to ``(query_id, id, rank, …)``.

    The rank filter becomes a partial top-k before the shuffle, so a query that
    matches most assets still ships k rows per task.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("query"), words))).alias("term"))
    hits = _scores(postings.join(asked, "term"), ["query_id", "image_id"]).withColumnRenamed("image_id", "id")
    allowed = assets.filter(F.col("ai_status") == "completed").select("id", "created_at")
    order = Window.partitionBy("query_id").orderBy(*ranked())
    placed = hits.join(allowed, "id").withColumn("rank", F.row_number().over(order))
    return placed.filter(F.col("rank") <= k).select("query_id", "id", "rank", "match_count", "relevance_score")


def _told(query: str) -> Column:
    entity = contains_ci(F.to_json("entities"), query)
    return contains_ci(F.col("content"), query) | F.coalesce(entity, F.lit(False))


def narrative_matches(narratives: DataFrame, query: str) -> DataFrame:
    """Narratives whose text or entities contain the raw query."""
    return narratives.filter(_told(query))


def narrative_texts(narratives: DataFrame) -> DataFrame:
    """``(id, text)``: what :func:`narrative_matches` looks through, for :func:`substring_index.append_texts`."""
    return narratives.select("id", F.concat_ws("\n", "content", F.to_json("entities")).alias("text"))


def indexed_narrative_matches(narratives: DataFrame, path: str, query: str, trace: list[int] | None = None) -> DataFrame:
    """:func:`narrative_matches` by a stored substring index of :func:`narrative_texts`."""
    return find_containing(narratives, path, [query], _told(query), trace=trace)


def search_with_fallback(
    postings: DataFrame,
    assets: DataFrame,
    narratives: DataFrame,
    query: str,
    page_no: int = 0,
    page_size: int = 20,
    words: Dictionary | Iterable[str] | None = None,
    **filters,
) -> DataFrame:
    """A short page is filled with assets whose narratives contain the query
    (newest narrative first, score 0.5, one match).  Pages are 0-based."""
    if not query.strip():
        raise ValueError("the query is blank")
    hits = search(postings, assets, query, page_size, page_no * page_size, words, **filters)
    hits = hits.select("id", "match_count", "relevance_score", "created_at", F.lit(0).alias("stage"))
    told = narrative_matches(narratives, query).groupBy(F.col("image_id").alias("id")).agg(F.max("created_at").alias("told_at"))
    extra = (
        told.join(hits.select("id"), "id", "left_anti")
        .join(assets.select("id"), "id", "left_semi")
        .orderBy(F.desc("told_at"), F.desc("id"))
        .limit(page_size)
    )
    extra = extra.select(
        "id",
        F.lit(1).cast("long").alias("match_count"),
        F.lit(0.5).alias("relevance_score"),
        F.col("told_at").alias("created_at"),
        F.lit(1).alias("stage"),
    )
    return hits.unionByName(extra).orderBy("stage", *ranked()).limit(page_size)


def query_associations(narratives: DataFrame, assets: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Narratives that contain the query with their assets; a hit in the text
    counts as ``content``, one in the entities only as ``entity``."""
    matched = narrative_matches(narratives, query).withColumn(
        "match_type", F.when(contains_ci(F.col("content"), query), F.lit("content")).otherwise(F.lit("entity"))
    )
    known = assets.select(F.col("id").alias("image_id"), "file_path", "file_name")
    joined = matched.join(known, "image_id").withColumn("relevance", F.lit(1.0))
    return page(joined, [F.desc("updated_at"), F.desc("id")], limit)
