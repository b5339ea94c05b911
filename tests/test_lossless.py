"""Nothing is dropped, doubled or switched by size."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from pictorium.checks import ENTRIES
from pictorium.operators import common, dedup
from pictorium.plans import ordering, scratch
from pictorium.streaming import jobs
from pictorium.streaming.runtime import stream_table


@pytest.mark.parametrize("n", [3, 601])
def test_text_ids_in_any_number(spark, n):
    df = spark.range(1000).select(F.concat(F.lit("v"), "id").alias("id")).unionByName(spark.createDataFrame([(None,)], "id string"))
    ids = [f"v{i}" for i in range(n)] + ["v0"]
    assert common.only_ids(df, ids).count() == n
    assert common.without_ids(df, ids).count() == 1001 - n


def test_ties_and_doubled_keys(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "key long, value string, version int")
    changes = [(1, "y", 5), (1, "x", 5), (1, "z", 4), (3, "n", 1), (3, "n", 1)]
    for rows in (changes, changes[::-1]):
        df = spark.createDataFrame(rows, base.schema)
        got = {(r["key"], r["value"]) for r in common.upsert_latest(base, df.repartition(4), ["key"], "version").collect()}
        assert got == {(1, "x"), (2, "b"), (3, "n")}
        by_value = common.upsert_latest(base, df, ["key"], "version", then=[F.desc("value")])
        assert {r["value"] for r in by_value.filter("key = 1").collect()} == {"y"}
        updated = common.update_where(base, df, "key", ["value"]).collect()
        assert sorted((r["key"], r["value"]) for r in updated) == [(1, "x"), (2, "b")]


def test_chunks_of_sparse_ids(spark):
    """One group holds a third of the rows; ids lie anywhere in 2^62."""
    n = 3000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("g"), F.abs(F.xxhash64("id")).bitwiseAND(F.lit(2**62 - 1)).alias("at"))
    got = ordering.number_within(rows, ["g"], "at", "nth", span=100)
    hot = [r["nth"] for r in got.filter("g = 0").orderBy("at").collect()]
    assert hot == list(range(1, n // 3 + 1))
    assert got.filter("g <> 0 and nth <> 1").count() == 0
    sizes = ordering._chunked(rows, "at", 100).groupBy("_chunk").count().agg(F.count("*"), F.max("count")).head()
    assert sizes[0] >= 20 and sizes[1] <= 400


def test_late_rows_are_kept(spark, tmp_path):
    """Batches whose event times go back by years."""
    rows = [(i, f"k{i % 7}", dt.datetime(2024 - i // 10, 1, 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "n int, hash string, ts timestamp")
    df.repartition(1).write.parquet(str(tmp_path / "late.parquet"))
    stream = stream_table(spark, str(tmp_path), "late", batches=4)
    assert sorted(r["hash"] for r in jobs.stream_exact_dedup(stream, "hash").select("hash").collect()) == [f"k{i}" for i in range(7)]


def test_ingest_knows_the_library(spark, tmp_path):
    rows = [(i, f"/in/{i}.jpg", b"\xff\xd8\xff\xe0" + bytes([i % 7])) for i in range(40)]
    df = spark.createDataFrame([(i, i, p, len(c), bytearray(c)) for i, p, c in rows], "n int, seq long, path string, length long, content binary")
    df.write.parquet(str(tmp_path / "files.parquet"))
    known = df.filter("seq < 3").select(F.sha2("content", 256).alias("file_hash"))
    assert jobs.stream_ingest(stream_table(spark, str(tmp_path), "files"), library=known).count() == 4


def test_a_finished_scan_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: str(tmp_path))
    assets = spark.createDataFrame([(i, "completed", f"{i % 5:016x}") for i in range(20)], "id long, ai_status string, phash string")

    def left(label):
        return [d for d in os.listdir(tmp_path / "pictorium") if d.startswith(f"{label}-")]

    scan = dedup.DuplicateScan(assets, 2)
    assert scan.summary().count() == 1 and left("scan")
    scan.close()
    assert not left("scan")
    one = scratch.Scratch(spark, "one")
    table, _ = one.write(spark.range(3))
    one.drop(table)
    one.close()
    assert not left("one")


@pytest.mark.parametrize("name", ["e1_tokenize", "g1_parse_ai_response", "g6_check_all", "l5_sanitize_log", "c9_document_fingerprint"])
def test_map_only_queries_do_not_shuffle(spark, data, name):
    plan = ENTRIES[name].run(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")
