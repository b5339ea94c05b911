"""Calibration, accuracy and library statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pictorium.operators import metrics as M
from pictorium.sources import adapters as A

from .registry import check, view, with_views

view("bins10", """
    SELECT CAST(least(floor(confidence * 10), 9) AS BIGINT) AS bin, avg(confidence) AS avg_confidence,
      avg(CAST(is_correct AS INTEGER)) AS accuracy, count(*) AS n, CAST(sum(CAST(is_correct AS INTEGER)) AS BIGINT) AS n_correct
    FROM cal_samples GROUP BY 1""", "cal_samples")
view("errors", """
    SELECT sum(abs(accuracy - avg_confidence) * n) / sum(n) AS ece, max(abs(accuracy - avg_confidence)) AS mce,
      CAST(sum(n) AS BIGINT) AS total_samples FROM bins10""", "bins10")


def r(column, places=9):
    return F.round(column, places).alias(column)


@check("h1_add_samples", """
    SELECT event_id, value / 40.0 BETWEEN 0 AND 1 AS accepted FROM events""")
def add_samples(spark, d):
    samples = A.table(spark, d, "events").select("event_id", (F.col("value") / 40.0).alias("confidence"))
    good, bad = M.split_samples(samples)
    return good.select("event_id", F.lit(True).alias("accepted")).unionByName(bad.select("event_id", F.lit(False).alias("accepted")))


@check("h2_calibration_bins", with_views("bins10", "SELECT bin, round(avg_confidence, 9) AS avg_confidence, round(accuracy, 9) AS accuracy, n, n_correct FROM bins10"))
def calibration_bins(spark, d):
    return M.calibration_bins(A.cal_samples(spark, d)).select("bin", r("avg_confidence"), r("accuracy"), "n", "n_correct")


@check("h3_ece", with_views("errors", "SELECT round(ece, 9) AS ece FROM errors"))
def ece(spark, d):
    return M.expected_error(A.cal_samples(spark, d)).select(r("ece"))


@check("h4_mce", with_views("errors", "SELECT round(mce, 9) AS mce FROM errors"))
def mce(spark, d):
    return M.maximum_error(A.cal_samples(spark, d)).select(r("mce"))


@check("h5_calibration_report", with_views("errors, bins10", """
    SELECT round(ece, 9) AS ece, round(mce, 9) AS mce, CAST(10 AS BIGINT) AS n_bins, total_samples,
      (SELECT string_agg(bin || ':' || n || ':' || n_correct, ',' ORDER BY bin) FROM bins10) AS bins, '2024-06-01' AS computed_at FROM errors"""))
def calibration_report(spark, d):
    out = M.calibration_report(A.cal_samples(spark, d), 10, "2024-06-01")
    text = F.array_join(F.transform("bins", lambda b: F.concat_ws(":", b["bin"].cast("string"), b["n"].cast("string"), b["n_correct"].cast("string"))), ",")
    return out.select(r("ece"), r("mce"), "n_bins", "total_samples", text.alias("bins"), "computed_at")


@check("h6_calibration_curve", with_views("bins10", "SELECT bin, round(avg_confidence, 9) AS avg_confidence, round(accuracy, 9) AS accuracy, n FROM bins10"))
def calibration_curve(spark, d):
    return M.calibration_curve(A.cal_samples(spark, d)).select("bin", r("avg_confidence"), r("accuracy"), "n")


# one report per category of the samples, in alphabetical order
view("reports", """
    SELECT row_number() OVER (ORDER BY predicted_category) AS id, predicted_category, sum(gap * n) / sum(n) AS ece, CAST(sum(n) AS BIGINT) AS total_samples FROM
      (SELECT predicted_category, count(*) AS n, abs(avg(CAST(is_correct AS INTEGER)) - avg(confidence)) AS gap FROM cal_samples
       GROUP BY predicted_category, least(floor(confidence * 10), 9)) GROUP BY predicted_category""", "cal_samples")


def reports(spark, d):
    """Reports over time: one per category; their number is fixed by the
    categories, so numbering them is a small window."""
    from pyspark.sql import Window

    bins = M.calibration_bins(A.cal_samples(spark, d), 10, ["predicted_category"])
    per = M.calibration_errors(bins, ["predicted_category"])
    number = F.row_number().over(Window.orderBy("predicted_category")).cast("long")
    return per.withColumn("id", number).withColumn("created_at", F.expr("timestamp_ntz'2024-01-01' + id * interval '1' day"))


@check("h7_latest_report", with_views("reports", "SELECT id, predicted_category, round(ece, 9) AS ece, total_samples FROM reports ORDER BY id DESC LIMIT 1"))
def latest_report(spark, d):
    return M.latest_report(reports(spark, d)).select("id", "predicted_category", r("ece"), "total_samples")


@check("h8_calibration_change", with_views("reports", """
    SELECT round(p.ece, 9) AS before_ece, round(n.ece, 9) AS after_ece,
      round(CASE WHEN p.ece > 0 THEN greatest((p.ece - n.ece) / p.ece * 100, 0) ELSE 0 END, 6) AS improvement_percent
    FROM reports n JOIN reports p ON p.id = n.id - 1 WHERE n.id = (SELECT max(id) FROM reports)"""))
def calibration_change(spark, d):
    return M.calibration_change(reports(spark, d)).select(r("before_ece"), r("after_ece"), r("improvement_percent", 6))


_TREND = """
    SELECT strftime(ai_processed_at, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (WHERE ai_tag_status = 'verified') AS correct,
      round(count(*) FILTER (WHERE ai_tag_status = 'verified') / count(*), 9) AS accuracy
    FROM assets WHERE ai_status = 'completed' AND ai_processed_at >= TIMESTAMP '2024-01-06' AND ai_processed_at < TIMESTAMP '2024-01-27' GROUP BY 1"""


@check("h9_accuracy_trend", with_views("assets", _TREND))
def accuracy_trend(spark, d):
    out = M.accuracy_trend(A.assets(spark, d), "2024-01-26", 20)
    return out.select(F.col("day").cast("string").alias("day"), "total", "correct", r("accuracy"))


@check("h10_category_accuracy", with_views("assets", """
    SELECT coalesce(ai_category, 'uncategorized') AS category, count(*) AS total, count(*) FILTER (WHERE ai_tag_status = 'verified') AS verified,
      count(*) FILTER (WHERE ai_tag_status = 'provisional') AS provisional, count(*) FILTER (WHERE ai_tag_status = 'rejected') AS rejected,
      round(coalesce(avg(ai_confidence), 0), 9) AS average_confidence FROM assets WHERE ai_status = 'completed' GROUP BY ai_category"""))
def category_accuracy(spark, d):
    return M.category_accuracy(A.assets(spark, d)).withColumn("average_confidence", F.round("average_confidence", 9))


@check("h11_library_totals", with_views("assets", """
    SELECT count(*) AS total_images, CAST(sum(file_size) AS BIGINT) AS total_bytes, CAST(sum(file_size) // count(file_size) AS BIGINT) AS average_bytes,
      max(file_size) AS largest_bytes FROM assets"""))
def library_totals(spark, d):
    return M.library_totals(A.assets(spark, d))


@check("h12_category_distribution", with_views("assets", "SELECT coalesce(ai_category, 'uncategorized') AS category, count(*) AS n FROM assets GROUP BY ai_category"))
def category_distribution(spark, d):
    return M.category_distribution(A.assets(spark, d))


@check("h13_status_counts", with_views("assets", "SELECT " + ", ".join(
    [f"count(*) FILTER (WHERE ai_status = '{s}') AS {s}" for s in ("pending", "processing", "completed", "failed")]
    + [f"count(*) FILTER (WHERE ai_tag_status = '{s}') AS {s}" for s in ("verified", "provisional", "rejected")]) + " FROM assets"))
def status_counts(spark, d):
    return M.status_counts(A.assets(spark, d))


@check("h14_tag_cloud", with_views("assets", "SELECT tag, count(*) AS n FROM (SELECT unnest(ai_tags) AS tag FROM assets) GROUP BY 1 ORDER BY n DESC, tag LIMIT 50"))
def tag_cloud(spark, d):
    return M.tag_cloud(A.assets(spark, d))


@check("h15_progress", with_views("assets", """
    SELECT total, completed, failed, total - completed - failed AS pending, round(completed / total * 100, 2) AS percent,
      CASE WHEN total - completed - failed = 0 THEN 'completed' ELSE 'processing' END AS state
    FROM (SELECT count(*) AS total, count(*) FILTER (WHERE ai_status = 'completed') AS completed, count(*) FILTER (WHERE ai_status = 'failed') AS failed FROM assets)"""))
def progress(spark, d):
    return M.progress(A.assets(spark, d))


@check("h16_relative_bar", with_views("assets", """
    SELECT tag, n, round(n / greatest(1, max(n) OVER ()), 9) AS bar FROM (SELECT unnest(ai_tags) AS tag, 1 AS one FROM assets) t
    JOIN (SELECT tag AS k, count(*) AS n FROM (SELECT unnest(ai_tags) AS tag FROM assets) GROUP BY 1) c ON c.k = t.tag GROUP BY tag, n"""))
def relative_bar(spark, d):
    return M.relative_bar(M.tag_cloud(A.assets(spark, d), None)).select("tag", "n", r("bar"))


@check("h17_component_health", """
    SELECT 'documents' AS component, count(*) AS n_rows, 'healthy' AS status FROM documents
    UNION ALL SELECT 'labels', count(*), 'healthy' FROM labels
    UNION ALL SELECT 'nothing', count(*), 'empty' FROM events WHERE event_type = 'none'""")
def component_health(spark, d):
    nothing = A.table(spark, d, "events").filter(F.col("event_type") == "none")
    return M.component_health(documents=A.table(spark, d, "documents"), labels=A.table(spark, d, "labels"), nothing=nothing)
