"""The substring index against a scan of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from pictorium.functions.text import contains_ci
from pictorium.operators import substring_index as G


def all_grams(t):
    low = (t or "").lower()
    padded = low + "\x01\x01"
    return {padded[i : i + 3] for i in range(len(low))}


TEXTS = ["", None, "a", "ab", "Abc", "aaaa", "日本語の文章", "emoji 👩‍👧 x", "ÀÉ über STRASSE", "50% of_all \\ (x)", "line\nbreak\tTab", "x" * 3000 + "needle"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(4)
    pool = ["alpha", "beta", "Gamma", "delta", "of", "the", "zeta-9", "éclair"]
    texts = TEXTS + [" ".join(rng.choices(pool, k=rng.randint(1, 12))) + (" unicorn" if i % 150 == 7 else "") for i in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    path = str(tmp_path_factory.mktemp("grams") / "i")
    for k in range(2):
        G.append_texts(rows.filter(F.col("id") % 2 == k), path, bits=5)
    G.append_texts(spark.createDataFrame([(None, "unicorn"), (9000, "unicorn that is gone")], "id long, text string"), path, bits=5)
    return rows, path


def test_grams_start_at_every_character(spark, stored):
    rows, _ = stored
    for r in rows.select("text", G.grams(F.col("text")).alias("g")).collect():
        assert set(r["g"] or []) == all_grams(r["text"]) and len(r["g"] or []) == len(all_grams(r["text"]))


@pytest.mark.parametrize("needle", ["unicorn", "UNICORN", "a", "ab", "abc", "aaa", "of", "a b", "本語", "日本語", "👧", "à", "É", "50%", "_", "\\", "x needle", "xneedle", "nowhere", "gamma the", "\n", "ta-9"])
def test_equal_to_a_scan(spark, stored, needle):
    rows, path = stored
    predicate = F.coalesce(contains_ci(F.col("text"), needle), F.lit(False))
    want = sorted(r["id"] for r in rows.filter(predicate).collect())
    trace = []
    assert sorted(r["id"] for r in G.find_containing(rows, path, [needle], predicate, trace=trace).collect()) == want
    assert trace[0] <= 3 * len(want) + 2  # few rows are verified in vain


def test_rarest_grams_are_read(spark, stored):
    """'the unicorn' has common and rare grams; candidates are those of the rare ones."""
    _, path = stored
    assert G.candidates(spark, path, "unicorn").count() <= 6
    plan = spark.read.parquet(path).filter(F.col("gram").isin(["uni"]))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram" in plan or "In(gram" in plan


def test_several_needles(spark, stored):
    rows, path = stored
    predicate = contains_ci(F.col("text"), "unicorn") | contains_ci(F.col("text"), "needle")
    got = G.find_containing(rows, path, ["unicorn", "needle"], predicate)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in rows.filter(predicate).collect())
    assert G.find_containing(rows, path, [], F.lit(True)).count() == 0
