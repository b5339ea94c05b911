"""Streams over several files equal the batch result, also across restarts."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from pictorium.streaming import jobs
from pictorium.streaming.runtime import stream_assets, stream_files


def write_files(df, folder, parts):
    os.makedirs(folder, exist_ok=True)
    for i in range(parts):
        df.filter(F.pmod("n", F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(folder)


def attempts(spark, n=400):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    # a third of the attempts are for one item
    rows = [
        (i, "hot" if i % 3 == 0 else f"item{rng.randrange(60)}", start + dt.timedelta(seconds=rng.randrange(10**6)), rng.random() < 0.25)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "n int, item string, ts timestamp, ok boolean")


def test_retry_state_over_files(spark, tmp_path):
    df = attempts(spark)
    write_files(df, str(tmp_path / "in"), 4)
    stream = stream_files(spark, str(tmp_path / "in"), df.schema, max_files=1)
    want = {tuple(r) for r in jobs.retry_state(df).collect()}
    assert {tuple(r) for r in jobs.stream_retry_state(stream).collect()} == want
    assert {tuple(r) for r in jobs.stream_retry_updates(stream).collect()} == want


def test_error_patterns_continue_after_restart(spark, tmp_path):
    df = attempts(spark).select("n", F.col("item").alias("pattern_name"), "ts")
    where = {"out": str(tmp_path / "out"), "checkpoint": str(tmp_path / "cp")}
    folder = str(tmp_path / "in")
    write_files(df.filter("n < 200"), folder, 2)
    jobs.stream_error_patterns(stream_files(spark, folder, df.schema, max_files=1), **where)
    write_files(df.filter("n >= 200"), folder, 2)
    out = jobs.stream_error_patterns(stream_files(spark, folder, df.schema, max_files=1), **where)
    want = df.groupBy("pattern_name").agg(F.count(F.lit(1)), F.min("ts"), F.max("ts"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_ingest_remembers_earlier_batches(spark, tmp_path):
    rows = [(i, f"/in/{i}.jpg", b"\xff\xd8\xff\xe0" + bytes([i % 7])) for i in range(40)] + [(40, "/in/x.txt", b"abcd")]
    df = spark.createDataFrame([(i, i, p, len(c), bytearray(c)) for i, p, c in rows], "n int, seq long, path string, length long, content binary")
    write_files(df, str(tmp_path / "in"), 4)
    out = jobs.stream_ingest(stream_files(spark, str(tmp_path / "in"), df.schema, max_files=1)).collect()
    assert len(out) == 7 and len({r["file_hash"] for r in out}) == 7


def test_exact_dedup_over_batches(spark, tmp_path):
    df = attempts(spark).select("n", F.col("item").alias("hash"), "ts")
    write_files(df, str(tmp_path / "in"), 3)
    stream = stream_files(spark, str(tmp_path / "in"), df.schema, max_files=1)
    got = [r["hash"] for r in jobs.stream_exact_dedup(stream, "hash").select("hash").collect()]
    assert len(got) == len(set(got)) == df.select("hash").distinct().count()


def test_calibration_sums_merge(spark, tmp_path):
    from pictorium.operators import metrics

    df = attempts(spark).select("n", ((F.col("n") * 37 % 100) / 100.0).alias("confidence"), F.col("ok").alias("is_correct"))
    write_files(df, str(tmp_path / "in"), 3)
    bins, errors = jobs.stream_calibration(stream_files(spark, str(tmp_path / "in"), df.schema, max_files=1))
    want = metrics.calibration_errors(metrics.calibration_bins(df)).head()
    got = errors.head()
    assert abs(got["ece"] - want["ece"]) < 1e-9 and abs(got["mce"] - want["mce"]) < 1e-9 and got["total_samples"] == 400


def test_stream_assets_sees_new_files(spark, tmp_path):
    from pictorium.streaming.runtime import drain, read_batches

    folder = tmp_path / "watched"
    folder.mkdir()
    (folder / "a.png").write_bytes(b"1")
    (folder / "a.txt").write_bytes(b"1")
    where = {"out": str(tmp_path / "out"), "checkpoint": str(tmp_path / "cp")}
    rows = stream_assets(spark, str(folder)).drop("content")
    drain(rows, **where)
    (folder / "b.png").write_bytes(b"2")
    drain(stream_assets(spark, str(folder)).drop("content"), **where)
    seen = read_batches(spark, where["out"], rows.schema).collect()
    assert sorted((r["path"].rsplit("/", 1)[-1], r["batch_id"]) for r in seen) == [("a.png", 0), ("b.png", 1)]


def test_stream_table_deals_small_files(spark, tmp_path):
    """A table of many input splits becomes as many files, and still a few batches."""
    from pictorium.streaming.runtime import drain, read_batches, stream_table

    rows = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    rows.repartition(12).write.parquet(str(tmp_path / "many.parquet"))
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        stream = stream_table(spark, str(tmp_path), "many")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    got = read_batches(spark, drain(stream.withColumn("file", F.input_file_name())), stream.schema.add("file", "string"))
    assert sorted(r["id"] for r in got.select("id").collect()) == list(range(3000))
    assert got.select("batch_id").distinct().count() == 3 and got.groupBy("file").count().agg(F.max("count")).head()[0] < 500


def test_retry_updates_share_state_rows(spark, tmp_path):
    """Items of one bucket keep states of their own, over batches and rows without a time or an outcome."""
    df = attempts(spark)
    write_files(df, str(tmp_path / "in"), 3)
    stream = stream_files(spark, str(tmp_path / "in"), df.schema, max_files=1)
    want = {tuple(r) for r in jobs.retry_state(df).collect()}
    assert {tuple(r) for r in jobs.stream_retry_updates(stream, buckets=2).collect()} == want
    odd = spark.createDataFrame([(0, "a", None, False), (1, "a", None, True), (2, "b", dt.datetime(2024, 1, 1), None), (3, "b", dt.datetime(2024, 1, 2), False)], df.schema)
    write_files(odd, str(tmp_path / "odd"), 2)
    got = jobs.stream_retry_updates(stream_files(spark, str(tmp_path / "odd"), df.schema, max_files=1), buckets=1).collect()
    assert sorted((r["item"], r["status"], r["retry_count"]) for r in got) == [("a", "pending", 0), ("b", "pending", 1)]
