"""Exact duplicates, licence notices and URL filters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from pictorium.llm import exact, licenses, urls
from pictorium.llm.queries import QUERIES


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, data, name):
    problem, *_ = compare(spark, connect(data), data, *QUERIES[name])
    assert not problem


def python_nodes(df):
    plan = df._jdf.queryExecution().toString()
    return [w for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if w in plan.replace("PythonRDD", "")]


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op6_license_scan", "op7_url_filter"])
def test_native_plans(spark, data, name):
    assert python_nodes(QUERIES[name][0](spark, data)) == []


def groups(rows):
    out = {}
    for i, t in rows:
        out.setdefault(t or "", []).append(i)
    return out


@pytest.mark.parametrize("capacity,key", [(200_000, exact.text_key), (1, exact.text_key), (2, lambda t: F.length(t).cast("long")), (3, lambda t: F.lit(7).cast("long"))])
def test_exact_with_splits_and_chains(odd, capacity, key):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = exact.exact_duplicates(odd, capacity, key).collect()
    assert len(got) == len(rows)
    by_text = groups(rows)
    by_id = {i: t or "" for i, t in rows}
    for r in got:
        ids = by_text[by_id[r["doc_id"]]]
        keep = max([i for i in ids if i is not None], default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)
    kept = exact.drop_exact_duplicates(odd, capacity, key)
    assert kept.columns == odd.columns
    assert sorted(t or "" for t, in kept.select("text").collect()) == sorted(by_text)


def test_exact_directory_covers_every_key(spark):
    entries = spark.range(1000).select(F.xxhash64("id").alias(exact.KEY))
    depth, buckets = exact.build_directory(entries, 10)
    slots = exact.directory_frame(entries, depth, buckets)
    assert slots.count() == 2**depth == slots.select("slot").distinct().count()
    placed = entries.join(slots, exact.slot_of(F.col(exact.KEY), depth) == F.col("slot"))
    assert placed.groupBy("bucket").count().agg(F.max("count")).head()[0] <= 10
    assert placed.count() == 1000


def test_exact_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    got = exact.exact_duplicates(docs, 50)
    assert got.filter("group_size = 1000 and keep_id = 2997").count() == 1000
    assert got.filter("group_size = 1 and kept").count() == 2000


def test_licences(odd, none):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(odd).collect()}
    r = got[10]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (14, 2, 3, 9)
    assert (r["base_labels"], r["labels"], r["score"]) == ("cc-by,mit", "cc-by,mit,notice-cc-by-nc,notice-mit", 1.0)
    assert (got[2]["n_words"], got[2]["first_word"], got[2]["labels"], got[2]["score"]) == (0, None, "", 0.0)
    assert got[11]["n_words"] == 30_000
    assert licenses.scan_licenses(odd).count() == odd.count()
    assert licenses.scan_licenses(none).count() == 0


def test_licence_threshold_equals_brute_force(spark):
    import re

    words = "this work is licensed under the gnu general public license version 3 other words".split()
    rows = [(i, " ".join(w for k, w in enumerate(words) if i >> k & 1)) for i in range(0, 2**14, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold in (0.5, 0.8, 1.0):
        got = {r["doc_id"]: r["score"] for r in licenses.scan_licenses(docs, threshold=threshold, phrases=licenses.PHRASES[1:2]).collect()}
        for i, text in rows:
            have = set(re.split(r"\W+", text))
            shares = [len(have & set(t.split())) / len(set(t.split())) for t in licenses.TEMPLATES.values()]
            assert got[i] == max([s for s in shares if s >= threshold - 1e-9], default=0.0)


def test_urls_at_fetch_time(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    changes = spark.createDataFrame(
        [
            ("block", "example.com", day(10), "add"),
            ("block", "example.com", day(10), "add"),
            ("block", "example.com", day(20), "remove"),
            ("block", "example.com", day(200), "add"),
            ("allow", "good.example.com", day(0), "add"),
            ("block", "good.example.com/bad", day(0), "add"),
            ("block", "other.org", day(5), "remove"),
            (None, "other.org", day(5), "add"),
        ],
        "list string, pattern string, changed_at timestamp, action string",
    )
    captures = spark.createDataFrame(
        [
            (1, "http://x.example.com/a", day(9)),
            (2, "http://x.example.com/a", day(10)),
            (3, "http://X.EXAMPLE.com:80/a", day(20)),
            (4, "http://example.com", day(300)),
            (5, "https://good.example.com/fine/x", day(15)),
            (6, "https://good.example.com/bad/x", day(15)),
            (7, "https://notexample.com/", day(15)),
            (8, None, day(15)),
            (9, "no url", day(15)),
            (10, "http://other.org/", day(15)),
            (11, "http://example.com/", None),
            (2, "http://x.example.com/a", day(10)),
        ],
        "page_id long, url string, fetched_at timestamp",
    )
    got = urls.judge_captures(captures, changes).collect()
    assert sorted((r["page_id"], r["verdict"], r["n_active"]) for r in got) == [
        (1, "none", 0), (2, "block", 1), (2, "block", 1), (3, "none", 0), (4, "block", 1), (5, "allow", 2),
        (6, "block", 3), (7, "none", 0), (8, "none", 0), (9, "none", 0), (10, "none", 0), (11, "none", 0),
    ]
    assert {r["verdict"] for r in urls.judge_captures(captures, changes.limit(0)).collect()} == {"none"}
    assert urls.judge_captures(captures.limit(0), changes).count() == 0


@pytest.mark.parametrize("width", [40, 72, 10_000])
def test_wrapped_notices_are_found(spark, width):
    """Every template, in mixed case between other words and wrapped at some column, also at the borders of windows."""
    import textwrap

    rows = []
    for shift in (0, 3, 40, 61, 127):
        for k, text in licenses.TEMPLATES.items():
            words = [f"filler{i}" for i in range(shift)] + text.upper().split() + ["and", "more", "follows"] * 12
            rows.append((len(rows), "\n".join(textwrap.wrap(" ".join(words), width)), k))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan_licenses(docs).collect()}
    assert all(label in got[i] for i, _, label in rows)
    scattered = " ".join(w + " x" * 40 for w in licenses.TEMPLATES["terms-mit"].split())
    none = spark.createDataFrame([(1, "\n".join(scattered.split()))], "doc_id long, text string")
    assert licenses.scan_licenses(none).head()["labels"] == ""


def test_two_lists_on_one_pattern(spark):
    """At equal specificity allow wins, then the larger list name, as the docstring says."""
    from datetime import datetime

    at = datetime(2024, 3, 1)
    captures = spark.createDataFrame([(1, "http://a.example.com/x", at), (2, "http://b.example.org/x", at)], "page_id long, url string, fetched_at timestamp")
    changes = [(name, "a.example.com", at, "add") for name in ("aaa", "bbb")] + [(name, "b.example.org", at, "add") for name in ("allow", "zzz")]
    frame = spark.createDataFrame(changes, "list string, pattern string, changed_at timestamp, action string")
    got = {r["page_id"]: (r["list"], r["verdict"]) for r in urls.judge_captures(captures, frame).collect()}
    assert got == {1: ("bbb", "block"), 2: ("allow", "allow")}


def test_far_dates_add_one_slot_each(spark):
    """A fetch in the year 9999 or 1900 stretches no interval over the slots between."""
    from datetime import datetime

    from pyspark.sql import functions as F

    near = datetime(2024, 3, 1)
    captures = spark.createDataFrame([(1, "http://a.com/x", near), (2, "http://a.com/x", datetime(9999, 12, 1)), (3, "http://a.com/x", datetime(1900, 1, 1)), (4, "http://a.com/x", None)], "page_id long, url string, fetched_at timestamp")
    changes = spark.createDataFrame([("block", "a.com", datetime(2024, 1, 1), "add")], "list string, pattern string, changed_at timestamp, action string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge_captures(captures, changes).collect()} == {1: "block", 2: "block", 3: "none", 4: "none"}
    runs = urls.fetch_runs(captures.select(F.unix_seconds("fetched_at").alias("at")))
    assert len(runs) == 3 and all(a == b for a, b in runs)
    for runs in ([(-3, -1), (4, 4), (6, 9), (10**5, 10**5)], [(0, 0)], []):
        held = [s for a, b in runs for s in range(a, b + 1)]
        for first, last in ((-10, None), (-2, 7), (5, 5), (4, 4), (8, None), (7, 3)):
            got = spark.range(1).select(urls.slots_met(F.lit(first).cast("long"), F.lit(last).cast("long"), runs).alias("s")).head()["s"]
            assert got == [s for s in held if first <= s and (last is None or s <= last)]
