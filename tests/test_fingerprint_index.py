"""The stored fingerprint index against all pairs."""

import random

import pytest

from pictorium.operators import fingerprint_index as I


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def prints(rng, n):
    """Random words, near ones, copies, and a third of all words with an empty upper half."""
    words = [rng.getrandbits(64) for _ in range(n)]
    words += [w ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 12))) for w in words]
    words += [rng.getrandbits(24) for _ in range(n)] + words[:20] + [0] * 30
    return [(i, signed(w)) for i, w in enumerate(words)]


def brute(queries, rows, radius):
    return sorted((q, i, bin((q ^ w) & (1 << 64) - 1).count("1")) for q in set(queries) for i, w in rows if w is not None and bin((q ^ w) & (1 << 64) - 1).count("1") <= radius)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = prints(rng, 150)
    path = str(tmp_path_factory.mktemp("prints") / "i")
    rng.shuffle(rows)
    for part in (rows[:200], rows[200:201], rows[201:]):
        I.append_fingerprints(spark.createDataFrame(part + [(-1, None)], "id long, word long"), path)
    return rows, path


@pytest.mark.parametrize("radius,most", [(0, 10**6), (3, 10**6), (5, 10**6), (10, 10**6), (10, 0), (17, 10**6)])
def test_equal_to_all_pairs(spark, stored, radius, most):
    rows, path = stored
    asked = [w for _, w in rows[:: 40 if radius > 12 else 9]] + [0, -1, 12345]
    queries = spark.createDataFrame([(w,) for w in asked + asked[:3]] + [(None,)], "word long")
    got = I.search_fingerprints(spark, path, queries, radius, most)
    assert sorted(map(tuple, got.collect())) == brute(asked, rows, radius)


def test_index_is_not_shuffled_and_folders_are_pruned(spark, stored):
    _, path = stored
    one = spark.createDataFrame([(77,)], "query long")
    plan = I.index_candidates(spark, path, one, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert "PartitionFilters: [slot" in plan and "In(key" in plan


def test_appending_reads_nothing_stored(spark, stored, tmp_path):
    rows, _ = stored
    path = str(tmp_path / "i")
    I.append_fingerprints(spark.createDataFrame(rows[:50], "id long, word long"), path)
    before = {f for f in spark.read.parquet(f"{path}/words").inputFiles()}
    I.append_fingerprints(spark.createDataFrame(rows[50:60], "id long, word long"), path)
    assert before < set(spark.read.parquet(f"{path}/words").inputFiles())


def test_limits(spark, stored):
    _, path = stored
    with pytest.raises(ValueError):
        I.index_candidates(spark, path, spark.createDataFrame([(1,)], "query long"), 20)
    assert I.search_fingerprints(spark, path, spark.createDataFrame([], "word long"), 5).count() == 0
