"""Ranking and predecessor search for groups too large for one task.

A plain window sorts a whole group in one task.  Here the rows are dealt to
chunks by ranges of the order column, windows run per (group, chunk), and
small per-chunk totals are carried across chunks.  The ranges are quantiles that Spark samples, so
chunks have about ``span`` rows however the values lie, dense or sparse.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, materialize
from .skew import shuffled

SPAN = 1 << 20


def _chunked(rows: DataFrame, order: str, span: int) -> DataFrame:
    """The rows with ``_chunk``, which grows with ``order``; equal values share a chunk."""
    scratch = Scratch(rows.sparkSession, "chunks")
    stored, seen = scratch.write(rows, n=F.count(F.lit(1)))
    dealt = stored.repartitionByRange(max(1, math.ceil(seen["n"] / span)), order)
    table, _ = scratch.write(dealt.withColumn("_chunk", F.spark_partition_id()))
    scratch.drop(stored)
    return table


def number_within(rows: DataFrame, keys: list[str], order: str, out: str, span: int = SPAN) -> DataFrame:
    """``row_number() over (partition by keys order by order)``, starting at 1."""
    marked = _chunked(rows, order, span)
    chunk_keys = [*keys, "_chunk"]
    sizes = marked.groupBy(*chunk_keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*chunk_keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*chunk_keys).orderBy(order)
    numbered = marked.withColumn("_rank", F.row_number().over(inside))
    safe = [numbered[k].eqNullSafe(offsets[k]) for k in chunk_keys]
    joined = numbered.join(offsets, safe)
    kept = [numbered[c] for c in rows.columns]
    return joined.select(*kept, (F.col("_before") + F.col("_rank")).cast("long").alias(out))


def latest_before(
    rows: DataFrame, keys: list[str], order: str, is_base: str, out: str, span: int = SPAN, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Largest ``order`` among base rows of the same group below the own one.

    With ``carry`` the result is a struct of the order and those columns of
    the row found.
    """
    marked = _chunked(rows, order, span)
    chunk_keys = [*keys, "_chunk"]
    value = F.struct(order, *carry) if carry else F.col(order)
    base = F.when(F.col(is_base), value)
    tops = marked.groupBy(*chunk_keys).agg(F.max(base).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*chunk_keys, F.max("_top").over(earlier).alias("_carried"))
    inside = Window.partitionBy(*chunk_keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    near = marked.withColumn("_near", F.max(base).over(inside))
    joined = near.join(shuffled(carried), chunk_keys)
    return joined.withColumn(out, F.coalesce("_near", "_carried")).drop("_chunk", "_near", "_carried")


def running_max(rows: DataFrame, keys: list[str], order: str, value: Column, out: str, span: int = SPAN) -> DataFrame:
    """Largest ``value`` of the group up to and including the own row."""
    marked = _chunked(rows.withColumn("_value", value), order, span)
    chunk_keys = [*keys, "_chunk"]
    tops = marked.groupBy(*chunk_keys).agg(F.max("_value").alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*chunk_keys, F.max("_top").over(earlier).alias("_carried"))
    inside = Window.partitionBy(*chunk_keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    near = marked.withColumn("_near", F.max("_value").over(inside))
    joined = near.join(carried, chunk_keys).withColumn(out, F.greatest("_near", "_carried"))
    return joined.drop("_chunk", "_near", "_carried", "_value")


def number_all(rows: DataFrame, order: list[str], out: str, label: str = "numbered") -> DataFrame:
    """Dense 0-based numbers over the whole table in ``order``.

    Range partitioning sorts by partition; the counts of the partitions (one
    row each) give the offsets.
    """
    placed = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    placed = materialize(placed, label)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    numbered = placed.withColumn("_rank", F.row_number().over(inside))
    # one row per partition of the range shuffle: bounded by its partition count
    return numbered.join(F.broadcast(offsets), "_part").select(
        *rows.columns, (F.col("_before") + F.col("_rank") - 1).cast("long").alias(out)
    )
