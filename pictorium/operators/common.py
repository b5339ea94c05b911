"""Shared pieces: id sets and keyed merges."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def only_ids(df: DataFrame, ids: DataFrame | Iterable, column: str = "id") -> DataFrame:
    """Rows whose key is in ``ids`` (values, or a frame with column ``id``)."""
    return df.join(_keys(df, ids, column), column, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame | Iterable, column: str = "id") -> DataFrame:
    """Rows whose key is not in ``ids``; rows without a key stay."""
    return df.join(_keys(df, ids, column), column, "left_anti")


def _keys(df: DataFrame, ids: DataFrame | Iterable, column: str) -> DataFrame:
    return ids.select(F.col("id").alias(column)) if isinstance(ids, DataFrame) else id_frame(df, ids, column)


def id_frame(df: DataFrame, ids: Iterable, column: str = "id") -> DataFrame:
    """Given keys as a frame of the column's own type."""
    kind = T.StructType([T.StructField(column, df.schema[column].dataType)])
    return df.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], kind)


def one_per_key(changes: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of every key by ``order``.  Rows that tie in it are
    ordered by all their columns, so the choice never depends on partitioning."""
    rest = [F.to_json(F.col(c)) if isinstance(changes.schema[c].dataType, T.MapType) else F.col(c) for c in changes.columns]
    first = Window.partitionBy(*keys).orderBy(*order, *rest)
    return changes.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") == 1).drop("_rank")


def upsert_latest(base: DataFrame, changes: DataFrame, keys: list[str], version: str, ignore: bool = False, then: list[Column | str] | None = None) -> DataFrame:
    """Insert-or-replace by key: of several changes the highest ``version``
    wins (at equal version the first by ``then``), and any change beats the
    base.  ``ignore`` keeps existing base rows (insert-or-ignore)."""
    latest = one_per_key(changes, keys, [F.desc(version), *(then or [])])
    if ignore:
        return base.unionByName(latest.join(base.select(*keys), keys, "left_anti").select(*base.columns))
    return base.join(latest.select(*keys), keys, "left_anti").select(*base.columns).unionByName(latest.select(*base.columns))


def update_where(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keyed UPDATE: rows of ``changes`` set the given columns, to NULL as
    well; other rows stay as they are.  Of several changes of one key the first by
    their values counts."""
    changes = one_per_key(changes.select(key, *columns), [key], [])
    new = changes.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(new, key, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def page(df: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size) if offset else df.orderBy(*order).limit(size)
