"""Labelled rows for fitting classifiers, with a bound that does not grow with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

SAMPLE_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, fold: int, held_out: int, most: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, text, y)`` of at most ``most`` labelled rows outside the held-out fold.

    The rows are the first in the order of a hash of their id, so the choice does
    not depend on partitioning.  Only these ids (a bounded number) are broadcast to the scan of
    the documents, whose texts are not shuffled.  Labels that disagree about an id are left out."""
    open_rows = labels.filter(F.col(target).isin(0, 1) & (crc_mod(F.col("doc_id"), fold) != held_out) & F.col("doc_id").isNotNull())
    one = open_rows.groupBy("doc_id").agg(F.min(target).alias("y"), F.max(target).alias("y2")).filter("y = y2")
    ids = one.select("doc_id", F.col("y").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
