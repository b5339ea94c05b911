"""Import: validation, exact duplicates, outcome summary, broken links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pictorium.functions.files import extension, mime_from_extension, path_issue, reject_reason
from pictorium.functions.hashing import content_sha256
from pictorium.plans.scratch import materialize


def validate_assets(files: DataFrame) -> DataFrame:
    """Adds ``reason`` (NULL = accepted) and ``mime_type`` to rows with
    ``path``, ``length`` and ``content``; the path rules come first."""
    reason = F.coalesce(path_issue(F.col("path")), reject_reason(F.col("path"), F.col("length"), F.col("content")))
    return files.withColumn("reason", reason).withColumn("mime_type", mime_from_extension(extension(F.col("path"))))


def hash_content(files: DataFrame) -> DataFrame:
    return files.withColumn("file_hash", content_sha256(F.col("content")))


def exact_dedup(new: DataFrame, existing: DataFrame, order: str = "seq", column: str = "file_hash") -> DataFrame:
    """Rows whose hash is neither stored nor seen earlier in the batch.  The
    ``= 1`` filter keeps one row per hash and task before the shuffle."""
    first = Window.partitionBy(column).orderBy(order)
    kept = new.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") == 1).drop("_rank")
    return kept.join(existing.select(column), column, "left_anti").select(*new.columns)


def import_outcomes(files: DataFrame, existing: DataFrame, order: str = "seq") -> DataFrame:
    """``outcome`` per input row: error, duplicate or success.  The files are
    read and hashed once; what is kept of them is a small table."""
    checked = materialize(hash_content(validate_assets(files)).drop("content"), "checked")
    good = checked.filter(F.col("reason").isNull())
    fresh = exact_dedup(good.select(order, "file_hash"), existing, order).select(order, F.lit(True).alias("_fresh"))
    joined = checked.join(fresh, order, "left")
    outcome = (
        F.when(F.col("reason").isNotNull(), F.lit("error"))
        .when(F.col("_fresh"), F.lit("success"))
        .otherwise(F.lit("duplicate"))
    )
    return joined.withColumn("outcome", outcome).drop("_fresh")


def import_summary(outcomes: DataFrame, size: str = "length") -> DataFrame:
    return outcomes.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")
    )


def broken_links(catalog: DataFrame, listing: DataFrame, path: str = "file_path") -> DataFrame:
    """Catalog rows whose file is not in the listing any more."""
    return catalog.join(listing.select(path), path, "left_anti").select(*catalog.columns)


def mark_broken(catalog: DataFrame, listing: DataFrame, path: str = "file_path") -> DataFrame:
    seen = listing.select(path).distinct().withColumn("_there", F.lit(True))
    status = F.when(F.col("_there"), F.col("ai_status")).otherwise(F.lit("broken_link"))
    return catalog.join(seen, path, "left").withColumn("ai_status", status).select(*catalog.columns)
