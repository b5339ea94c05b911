"""Log lines: parsing, paging, statistics, filtered export.

Lines are rows ``(seq, line)`` with ``seq`` counting from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_log(lines: DataFrame) -> DataFrame:
    """Four space-separated fields; a shorter line is level UNKNOWN with the
    whole line as message."""
    parts = F.split("line", " ", 4)
    full = F.size(parts) >= 4

    def field(i: int, short: Column) -> Column:
        return F.when(full, F.get(parts, F.lit(i))).otherwise(short)

    level = F.regexp_replace(F.get(parts, F.lit(1)), r"^[{}]+|[{}]+$", "")
    return lines.select(
        "seq",
        field(0, F.lit("")).alias("timestamp"),
        F.when(full, level).otherwise(F.lit("UNKNOWN")).alias("level"),
        field(2, F.lit("")).alias("target"),
        field(3, F.col("line")).alias("message"),
    )


def level_filter(level: str | None) -> Column:
    return F.lit(True) if level is None else F.contains(F.col("line"), F.lit(level.upper()))


def page_log(lines: DataFrame, max_lines: int = 200, offset: int = 0, level: str | None = None) -> DataFrame:
    """The offset counts raw lines, the limit counts matching ones."""
    rest = lines.filter((F.col("seq") > offset) & level_filter(level))
    return parse_log(rest.orderBy("seq").limit(max_lines)).orderBy("seq")


def page_info(lines: DataFrame, max_lines: int = 200, offset: int = 0, level: str | None = None) -> DataFrame:
    shown = F.least(F.count_if((F.col("seq") > offset) & level_filter(level)), F.lit(max_lines).cast("long"))
    return lines.agg(F.count(F.lit(1)).alias("total_lines"), shown.alias("returned")).withColumn(
        "has_more", F.col("total_lines") > offset + F.col("returned")
    )


def log_stats(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).cast("long").alias("size_bytes"),
        F.count(F.lit(1)).alias("line_count"),
    )


def filter_log(lines: DataFrame, level: str | None = None) -> DataFrame:
    return lines.filter(level_filter(level))
