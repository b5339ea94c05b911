"""Narratives with the people, places and times they mention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pictorium.functions.entities import extract_entities


def write_narratives(rows: DataFrame, max_len: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(accepted with entities, refused)``: blank contents are refused."""
    blank = ~F.col("content").rlike(r"\S")
    accepted = rows.filter(~blank).withColumn("entities", extract_entities(F.col("content"), max_len))
    return accepted, rows.filter(F.coalesce(blank, F.lit(True)))


def get_narratives(narratives: DataFrame, image_id: int) -> DataFrame:
    return narratives.filter(F.col("image_id") == image_id)


def entity_rows(narratives: DataFrame) -> DataFrame:
    """One row per mention."""
    return narratives.select("id", "image_id", F.posexplode("entities").alias("position", "entity")).select(
        "id", "image_id", F.col("position").cast("long").alias("position"), "entity.type", "entity.value"
    )
