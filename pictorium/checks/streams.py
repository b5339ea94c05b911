"""Streaming queries, drained and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pictorium.sources import adapters as A
from pictorium.operators import ingest
from pictorium.streaming import jobs
from pictorium.streaming.runtime import drain, read_batches, stream_table

from .catalog import shown
from .metrics import r
from .registry import check, stamp, with_views


@check("a6_stream_documents", "SELECT doc_id, lang, source, n_chars FROM documents")
def stream_documents(spark, d):
    rows = stream_table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return read_batches(spark, drain(rows), rows.schema).drop("batch_id")


@check("n1_stream_ingest", with_views("validated", """
    SELECT file_hash, length, mime_type FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY seq) AS rn FROM validated WHERE reason IS NULL)
    WHERE rn = 1 AND file_hash NOT IN (SELECT file_hash FROM validated WHERE reason IS NULL AND seq % 9 = 0)"""))
def stream_ingest(spark, d):
    # which of several equal files comes first depends on the batches; the library holds some files already
    library = ingest.hash_content(ingest.validate_assets(A.incoming_files(spark, d).filter("seq % 9 = 0"))).filter("reason is null")
    out = jobs.stream_ingest(A.incoming_of(stream_table(spark, d, "documents")), library=library.select("file_hash"))
    return out.select("file_hash", "length", "mime_type")


@check("n2_stream_exact_dedup", "SELECT DISTINCT sha256(user_id || '/' || event_type || '/' || strftime(ts, '%Y-%m-%d')) AS hash FROM events")
def stream_exact_dedup(spark, d):
    events = stream_table(spark, d, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    key = F.sha2(F.concat_ws("/", F.col("user_id").cast("string"), "event_type", day), 256)
    return jobs.stream_exact_dedup(events.select(key.alias("hash"), "ts"), "hash").select("hash")


@check("n3_stream_progress", with_views("assets", "SELECT ai_status, count(*) AS n FROM assets GROUP BY 1"))
def stream_progress(spark, d):
    return jobs.stream_progress(A.assets_of(stream_table(spark, d, "documents"), A.table(spark, d, "labels")))


@check("n4_stream_error_patterns", with_views("error_events", f"""
    SELECT pattern_name, count(*) AS occurrence_count, {stamp('min(ts)')} AS first_seen, {stamp('max(ts)')} AS last_seen FROM error_events GROUP BY 1"""))
def stream_error_patterns(spark, d):
    out = jobs.stream_error_patterns(A.error_events_of(stream_table(spark, d, "events")))
    return out.select("pattern_name", "occurrence_count", shown("first_seen"), shown("last_seen"))


_RETRY = """
    WITH o AS (SELECT item, min(epoch_us(ts)) FILTER (WHERE ok) AS ok_us, list_sort(list(epoch_us(ts)) FILTER (WHERE NOT ok)) AS f FROM attempts GROUP BY 1),
    b AS (SELECT item, ok_us, coalesce(list_filter(f, lambda t: ok_us IS NULL OR t < ok_us), []) AS f FROM o),
    n AS (SELECT item, ok_us, f, CAST(least(len(f), 3) AS BIGINT) AS n FROM b)
    SELECT item, CASE WHEN n >= 3 THEN 'failed' WHEN ok_us IS NOT NULL THEN 'completed' ELSE 'pending' END AS status, n AS retry_count,
      CASE WHEN n < 3 AND ok_us IS NULL THEN f[n] + CAST(pow(2, n) * 1000000 AS BIGINT) END AS next_retry_us FROM n"""


@check("n5_retry_state_batch", with_views("attempts", _RETRY))
def retry_state(spark, d):
    return jobs.retry_state(A.attempts(spark, d))


@check("n5_stream_retry_state", with_views("attempts", _RETRY))
def stream_retry_state(spark, d):
    return jobs.stream_retry_state(A.attempts_of(stream_table(spark, d, "events")))


@check("n5_stream_retry_updates", with_views("attempts", _RETRY))
def stream_retry_updates(spark, d):
    return jobs.stream_retry_updates(A.attempts_of(stream_table(spark, d, "events")))


@check("n6_stream_daily_accuracy", with_views("assets", """
    SELECT strftime(ai_processed_at, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (WHERE ai_tag_status = 'verified') AS correct,
      round(count(*) FILTER (WHERE ai_tag_status = 'verified') / count(*), 9) AS accuracy
    FROM assets WHERE ai_status = 'completed' AND ai_processed_at IS NOT NULL GROUP BY 1"""))
def stream_daily_accuracy(spark, d):
    assets = A.assets_of(stream_table(spark, d, "documents"), A.table(spark, d, "labels"))
    return jobs.stream_daily_accuracy(assets).withColumn("accuracy", F.round("accuracy", 9))


@check("n7_stream_calibration", with_views("bins10, errors", """
    SELECT bin, round(avg_confidence, 9) AS avg_confidence, round(accuracy, 9) AS accuracy, n, n_correct, (SELECT round(ece, 9) FROM errors) AS ece,
      (SELECT round(mce, 9) FROM errors) AS mce FROM bins10"""))
def stream_calibration(spark, d):
    samples = A.cal_samples_of(stream_table(spark, d, "labels"), A.table(spark, d, "documents"))
    bins, errors = jobs.stream_calibration(samples)
    ece, mce = errors.select(r("ece")).scalar(), errors.select(r("mce")).scalar()
    return bins.select("bin", r("avg_confidence"), r("accuracy"), "n", "n_correct", ece.alias("ece"), mce.alias("mce"))
