"""Calibration, accuracy and library statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _n() -> Column:
    return F.count(F.lit(1))


def split_samples(samples: DataFrame, confidence: str = "confidence") -> tuple[DataFrame, DataFrame]:
    """Samples with a confidence in [0, 1], and the refused ones."""
    good = F.col(confidence).between(0.0, 1.0)
    return samples.filter(good), samples.filter(~F.coalesce(good, F.lit(False)))


def calibration_bins(samples: DataFrame, n_bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Non-empty bins: mean confidence, accuracy, counts."""
    index = F.least(F.floor(F.col("confidence") * n_bins), F.lit(n_bins - 1)).cast("long")
    hit = F.col("is_correct").cast("long")
    return samples.groupBy(*(by or []), index.alias("bin")).agg(
        F.avg("confidence").alias("avg_confidence"),
        F.avg(hit).alias("accuracy"),
        _n().alias("n"),
        F.sum(hit).alias("n_correct"),
    )


def calibration_errors(bins: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ECE and MCE from the bins: both in one pass over at most n_bins rows."""
    gap = F.abs(F.col("accuracy") - F.col("avg_confidence"))
    return bins.groupBy(*(by or [])).agg(
        F.coalesce(F.sum(gap * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("ece"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("mce"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_samples"),
    )


def expected_error(samples: DataFrame, n_bins: int = 10) -> DataFrame:
    return calibration_errors(calibration_bins(samples, n_bins)).select("ece")


def maximum_error(samples: DataFrame, n_bins: int = 10) -> DataFrame:
    return calibration_errors(calibration_bins(samples, n_bins)).select("mce")


def calibration_report(samples: DataFrame, n_bins: int = 10, computed_at: str | None = None) -> DataFrame:
    """One row with the errors and the bin list; none without samples."""
    bins = calibration_bins(samples, n_bins)
    gap = F.abs(F.col("accuracy") - F.col("avg_confidence"))
    listed = F.sort_array(F.collect_list(F.struct("bin", "avg_confidence", "accuracy", "n", "n_correct")))
    report = bins.agg(
        (F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"),
        F.max(gap).alias("mce"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_samples"),
        listed.alias("bins"),
    )
    return report.filter(F.col("total_samples") > 0).select(
        "ece", "mce", F.lit(n_bins).cast("long").alias("n_bins"), "total_samples", "bins", F.lit(computed_at).alias("computed_at")
    )


def calibration_curve(samples: DataFrame) -> DataFrame:
    return calibration_bins(samples, 10).select("bin", "avg_confidence", "accuracy", "n").orderBy("bin")


def latest_report(reports: DataFrame) -> DataFrame:
    return reports.orderBy(F.desc("id")).limit(1)


def calibration_change(reports: DataFrame) -> DataFrame:
    """Newest against previous ECE; no row with fewer than two reports."""
    two = reports.orderBy(F.desc("created_at"), F.desc("id")).limit(2)
    key = F.struct("created_at", "id")
    pair = two.agg(F.max_by("ece", key).alias("after_ece"), F.min_by("ece", key).alias("before_ece"), _n().alias("n"))
    gain = (F.col("before_ece") - F.col("after_ece")) / F.when(F.col("before_ece") > 0, F.col("before_ece")) * 100.0
    return pair.filter("n = 2").select(
        "before_ece", "after_ece", F.coalesce(F.greatest(gain, F.lit(0.0)), F.lit(0.0)).alias("improvement_percent")
    )


def accuracy_trend(assets: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per day: completed, verified, ratio, for the days up to ``as_of``."""
    last = F.lit(as_of).cast("date")
    since, until = F.date_sub(last, days).cast("timestamp_ntz"), F.date_add(last, 1).cast("timestamp_ntz")
    done = assets.filter((F.col("ai_status") == "completed") & (F.col("ai_processed_at") >= since) & (F.col("ai_processed_at") < until))
    good = F.count_if(F.col("ai_tag_status") == "verified")
    return (
        done.groupBy(F.to_date("ai_processed_at").alias("day"))
        .agg(_n().alias("total"), good.alias("correct"))
        .withColumn("accuracy", F.col("correct") / F.col("total"))
        .orderBy("day")
    )


def category_accuracy(assets: DataFrame) -> DataFrame:
    done = assets.filter(F.col("ai_status") == "completed")
    counts = [F.count_if(F.col("ai_tag_status") == s).alias(s) for s in ("verified", "provisional", "rejected")]
    grouped = done.groupBy("ai_category").agg(_n().alias("total"), *counts, F.coalesce(F.avg("ai_confidence"), F.lit(0.0)).alias("average_confidence"))
    named = grouped.select(F.coalesce("ai_category", F.lit("uncategorized")).alias("category"), *grouped.columns[1:])
    return named.orderBy(F.desc("total"), "category")


def library_totals(assets: DataFrame) -> DataFrame:
    size = F.col("file_size")
    total = F.coalesce(F.sum(size), F.lit(0))
    return assets.agg(
        _n().alias("total_images"),
        total.cast("long").alias("total_bytes"),
        F.coalesce(F.expr("sum(file_size) div nullif(count(file_size), 0)"), F.lit(0)).cast("long").alias("average_bytes"),
        F.coalesce(F.max(size), F.lit(0)).cast("long").alias("largest_bytes"),
    )


def category_distribution(assets: DataFrame) -> DataFrame:
    grouped = assets.groupBy("ai_category").agg(_n().alias("n"))
    named = grouped.select(F.coalesce("ai_category", F.lit("uncategorized")).alias("category"), "n")
    return named.orderBy(F.desc("n"), "category")


def status_counts(assets: DataFrame) -> DataFrame:
    """Four work states and three grades in a single pass."""
    states = [F.count_if(F.col("ai_status") == s).alias(s) for s in ("pending", "processing", "completed", "failed")]
    grades = [F.count_if(F.col("ai_tag_status") == s).alias(s) for s in ("verified", "provisional", "rejected")]
    return assets.agg(*states, *grades)


def tag_cloud(assets: DataFrame, k: int | None = 50) -> DataFrame:
    """Tags by falling count: the first ``k``, or all."""
    tags = assets.filter(F.col("ai_tags").isNotNull()).select(F.explode("ai_tags").alias("tag"))
    counted = tags.groupBy("tag").agg(_n().alias("n")).orderBy(F.desc("n"), "tag")
    return counted if k is None else counted.limit(k)


def progress(assets: DataFrame, paused: bool = False) -> DataFrame:
    """Queue view of the library: what is neither completed nor failed waits."""
    row = assets.agg(
        _n().alias("total"),
        F.count_if(F.col("ai_status") == "completed").alias("completed"),
        F.count_if(F.col("ai_status") == "failed").alias("failed"),
    )
    row = row.withColumn("pending", F.greatest(F.col("total") - F.col("completed") - F.col("failed"), F.lit(0).cast("long")))
    percent = F.round(F.col("completed") / F.when(F.col("total") > 0, F.col("total")) * 100, 2)
    state = (
        F.when(F.lit(paused), F.lit("paused"))
        .when(F.col("total") == 0, F.lit("idle"))
        .when(F.col("pending") == 0, F.lit("completed"))
        .otherwise(F.lit("processing"))
    )
    return row.withColumn("percent", F.coalesce(percent, F.lit(0.0))).withColumn("state", state)


def relative_bar(counts: DataFrame, column: str = "n") -> DataFrame:
    """Share of the largest count, for bar lengths."""
    top = counts.agg(F.max(column)).scalar()
    return counts.withColumn("bar", F.col(column) / F.greatest(F.lit(1).cast("long"), top))


def component_health(**tables: DataFrame) -> DataFrame:
    """One row per table: row count and status."""
    rows = [df.agg(_n().alias("n_rows")).select(F.lit(name).alias("component"), "n_rows") for name, df in tables.items()]
    status = F.when(F.col("n_rows") > 0, F.lit("healthy")).otherwise(F.lit("empty"))
    return reduce(lambda a, b: a.unionByName(b), rows).withColumn("status", status)
