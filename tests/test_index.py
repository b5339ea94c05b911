"""The stored, segmented index against plain search over all postings."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from pictorium.operators import index as X
from pictorium.operators import search as S

COLUMNS = "id long, file_path string, file_name string, ai_status string, ai_tags array<string>, ai_description string, ai_category string, ai_confidence double, source string, created_at timestamp_ntz, ai_tag_status string"


def library(spark, n, seed=1, start=0):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(40)]
    odds = [1 / (i + 1) for i in range(40)]
    rows = []
    for i in range(start, start + n):
        rows.append((
            i * 3 - 50, f"/p/{i}", f"{i}.jpg", rng.choice(["completed"] * 4 + ["failed"]), rng.sample(pool, rng.randint(0, 2)) if rng.random() < 0.5 else None,
            None if rng.random() < 0.05 else " ".join(rng.choices(pool, odds, k=rng.randint(0, 8))), rng.choice(["cat", "dog", None]), 0.5, "s",
            None if rng.random() < 0.05 else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.choice([i, i, rng.randrange(n)])), rng.choice(["verified", "verified", "rejected", None]),
        ))
    return spark.createDataFrame(rows, COLUMNS)


QUERIES = ["w0", "w0 w1", "w3 w39", "w39", "w38 w37 w0 cat", "nothing", "the", "id 7", "w5 dog w0 w0"]


def same(spark, index, assets, postings, **options):
    for q in QUERIES:
        for limit, offset in ((5, 0), (7, 11)) if q != QUERIES[1] else ((5, 0), (1000, 0)):
            want = [(r["id"], r["match_count"], r["relevance_score"]) for r in S.search(postings, assets, q, limit, offset).collect()]
            got = [(r["id"], r["match_count"], r["relevance_score"]) for r in X.search_index(index, assets, q, limit, offset, **options).collect()]
            assert got == want, (q, limit, offset)


def postings_of(frame):
    return sorted(map(tuple, frame.select("image_id", "term", "weight", "field").collect()))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    assets = library(spark, 300)
    path = str(tmp_path_factory.mktemp("index") / "small")
    return assets, X.create_index(assets, path, bits=5)


def test_pages_equal_plain_search(spark, small):
    assets, index = small
    assert postings_of(X.live_postings(spark, index)) == postings_of(S.build_index(assets))
    same(spark, index, assets, S.build_index(assets), waves=(1, 3))


def test_filters_and_empty(spark, small):
    assets, index = small
    want = S.search(S.build_index(assets), assets, "w0 w1", 9, category="cat", start="2024-01-01", end="2024-01-01 03:00:00")
    got = X.search_index(index, assets, "w0 w1", 9, waves=(2,), category="cat", start="2024-01-01", end="2024-01-01 03:00:00")
    assert [r["id"] for r in got.collect()] == [r["id"] for r in want.collect()]
    assert X.search_index(index, assets, "the", 9).count() == 0


def test_few_buckets_for_a_common_term(spark, tmp_path):
    """A term that every second asset holds: two buckets of 125 are read, and pages of few rows of the index."""
    n = 8000
    times = F.timestamp_seconds(F.lit(1.7e9).cast("long") + F.col("id") * 60).cast("timestamp_ntz")
    rows = spark.range(n).select(
        "id", F.lit("/p").alias("file_path"), F.lit("f").alias("file_name"), F.lit("completed").alias("ai_status"), F.array(F.when(F.col("id") % 500 == 3, F.lit("rare")).otherwise(F.lit("tag"))).alias("ai_tags"),
        F.when(F.col("id") % 2 == 0, F.lit("common word")).otherwise(F.lit("other word")).alias("ai_description"), F.lit("c").alias("ai_category"), F.lit(0.5).alias("ai_confidence"), F.lit("s").alias("source"),
        times.alias("created_at"), F.lit("verified").alias("ai_tag_status"))
    index = X.create_index(rows, str(tmp_path / "i"), bits=6)
    postings = S.build_index(rows)
    for query, most in (("common", 4), ("common rare", 40), ("common word tag", 4)):
        trace = []
        got = X.search_index(index, rows, query, 20, waves=(2, 8, 32), trace=trace).collect()
        assert [r["id"] for r in got] == [r["id"] for r in S.search(postings, rows, query, 20).collect()]
        assert trace[0].left == 125 and sum(w.buckets for w in trace) <= most, (query, trace)


def size(path):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_updates_merges_and_readers(spark, tmp_path):
    """Five changes with merges equal a rebuild; a change of 1 % writes about 1 %; a reader of an old version is not disturbed."""
    path = str(tmp_path / "i")
    base = library(spark, 3000, 5)
    index = X.create_index(base, path, bits=8)
    first, whole = index, size(path)
    before = postings_of(X.live_postings(spark, first))
    current = base
    for k in range(5):
        ids = [r["id"] for r in base.select("id").filter(F.col("id") % 100 == k).collect()]
        changed = library(spark, 3000, 50 + k).filter(F.col("id").isin(ids))
        old = size(path)
        index = X.update_index(index, changed)
        # files this small are mostly headers
        assert index.segments[-1]["postings"] < 0.02 * first.segments[0]["postings"] and size(path) - old < 0.1 * whole
        current = current.filter(~F.col("id").isin(ids)).unionByName(changed)
        if k == 2:
            index = X.remove_from_index(index, current.select("id").filter("id % 7 = 0"))
            current = current.filter("id % 7 <> 0")
        index = X.merge_index(spark, index, fan=2, smallest=300)
        assert postings_of(X.live_postings(spark, index)) == postings_of(S.build_index(current))
    assert len(index.segments) <= 3 and X.open_index(spark, path) == index
    same_queries = [(r["id"], r["relevance_score"]) for r in X.search_index(index, current, "w0 w3 cat", 25, waves=(1, 2)).collect()]
    assert same_queries == [(r["id"], r["relevance_score"]) for r in S.search(S.build_index(current), current, "w0 w3 cat", 25).collect()]
    assert postings_of(X.live_postings(spark, first)) == before  # opened before all changes
    assert X.vacuum(spark, path, keep=1) > 0
    assert postings_of(X.live_postings(spark, X.open_index(spark, path))) == postings_of(S.build_index(current))


def test_merge_of_everything_drops_tombstones(spark, tmp_path):
    index = X.create_index(library(spark, 100), str(tmp_path / "i"), bits=4)
    index = X.update_index(index, library(spark, 20, 9))
    merged = X.merge_index(spark, index, fan=2)
    assert len(merged.segments) == 1 and not merged.tombstones
    assert postings_of(X.live_postings(spark, merged)) == postings_of(X.live_postings(spark, index))
    assert X.merge_index(spark, merged, fan=2) == merged


def test_writers_that_race(spark, tmp_path):
    index = X.create_index(library(spark, 40), str(tmp_path / "i"), bits=4)
    X.update_index(index, library(spark, 5, 2))
    with pytest.raises(X.Conflict):
        X.update_index(index, library(spark, 5, 3))
    with pytest.raises(X.Conflict):
        X.create_index(library(spark, 5), str(tmp_path / "i"))
    with pytest.raises(FileNotFoundError):
        X.open_index(spark, str(tmp_path / "none"))


def test_lookup_prunes_the_scan(spark, small):
    """Term and bucket reach the scan; bounds are read without the postings."""
    _, index = small
    blocks = X._numbered(spark, index.segments).filter(F.col("term").isin(["w0"]) & F.col("bucket").isin([1, 2]))
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan.replace("EqualTo(term", "In(term") and "In(bucket" in plan
    bounds = X._numbered(spark, index.segments).filter(F.col("term") == "w0").select("bucket", "top", "newest")
    assert "weights" not in bounds._jdf.queryExecution().executedPlan().toString()
