"""Joins against one-row-per-key tables when a key may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 1000


def shuffled(table: DataFrame) -> DataFrame:
    """The table as a side of a shuffle join.  Tables of numbers are a few bytes a row on disk, so one with a row per asset or
    fingerprint looks small enough to be broadcast, and would grow in the driver with the input."""
    return table.hint("merge")


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    total: int,
    hot_rows: int = HOT_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Inner join of ``rows`` to ``table`` (one row per key).

    AQE cannot split a skewed key below an aggregate, so keys of more than
    ``max(hot_rows, total / 1000)`` rows are looked up by broadcast instead: by
    that rule there are fewer than 1000 of them, whatever the data size.  The
    other keys take a shuffle join.  ``total`` is the row count of ``rows``;
    ``sizes`` may carry a ready count ``n`` per key.
    """
    cut = max(hot_rows, total // MAX_HOT_KEYS)
    if total <= cut:
        return rows.join(table, keys)
    if sizes is None:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(sizes.filter(F.col("n") > cut).select(*keys))
    hot_table = F.broadcast(table.join(hot, keys, "left_semi"))
    cold = rows.join(hot, keys, "left_anti").join(table, keys)
    return rows.join(hot_table, keys).unionByName(cold)
