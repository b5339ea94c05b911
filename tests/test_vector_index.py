"""The stored cluster index of vectors against the products of all pairs."""

import numpy as np
import pytest

from pictorium.operators import vector_index as V

DIM = 12


def clustered(rng, n):
    """Clusters of several widths, random vectors, and a third of all rows copies of one vector."""
    centres = rng.normal(size=(12, DIM))
    near = centres[rng.integers(0, 12, n)] + rng.choice([0.02, 0.3], (n, 1)) * rng.normal(size=(n, DIM))
    return np.concatenate([near, rng.normal(size=(n // 4, DIM)), np.repeat(centres[:1], 5 * n // 8, 0)])


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(queries, rows, k, least):
    sims = unit(queries) @ unit(rows).T
    out = {}
    for q, s in enumerate(sims):
        best = sorted((-round(x, 9), i) for i, x in enumerate(s.tolist()) if x >= least)[:k]
        out[q] = [(i, -x) for x, i in best]
    return out


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    rows = clustered(rng, 400)
    path = str(tmp_path_factory.mktemp("vectors") / "i")
    frame = lambda a, b: spark.createDataFrame([(i, rows[i].tolist()) for i in range(a, b)] + [(-1, [1.0] * 3), (-2, [0.0] * DIM), (-3, None), (-4, [])], "id long, embedding array<double>")
    V.write_vector_index(frame(0, 500), path, DIM)
    V.append_vectors(frame(500, len(rows)), path)
    queries = np.concatenate([rows[:12] + 0.01, rng.normal(size=(6, DIM)), rows[-1:]])
    asked = [(i, q.tolist()) for i, q in enumerate(queries)]
    asked += [(100, [1.0, 2.0]), (101, None), (102, [0.0] * DIM)]
    return rows, queries, spark.createDataFrame(asked, "query_id long, embedding array<double>"), path


@pytest.mark.parametrize("k,least,options", [(5, 0.0, {}), (1, 0.9, {}), (40, 0.2, {"first": 1}), (3000, 0.0, {}), (5, 0.0, {"max_bounds": 10}), (5, 0.3, {"max_numbers": 20})])
def test_equal_to_all_pairs(stored, k, least, options):
    rows, queries, asked, path = stored
    got, _ = V.search_index(asked, path, k, least, **options)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["id"], round(r["similarity"], 9)))
    want = {q: x for q, x in brute(queries, rows, k, max(least, 1e-12)).items() if x}
    assert found.keys() == want.keys()
    for q, x in want.items():
        assert [i for i, _ in found[q]] == [i for i, _ in x]
        assert np.allclose([s for _, s in found[q]], [s for _, s in x], atol=1e-8)


def test_pushed_or_joined_parts_are_alike(stored, monkeypatch):
    _, _, asked, path = stored
    one = sorted(map(tuple, V.search_index(asked, path, 4)[0].collect()))
    monkeypatch.setattr(V, "MAX_PUSHED", 0)
    assert sorted(map(tuple, V.search_index(asked, path, 4)[0].collect())) == one


def test_reads_few_parts(stored):
    """Queries inside clusters stop early, and the scan is told which parts to read."""
    _, _, asked, path = stored
    got, waves = V.search_index(asked.filter("query_id < 12"), path, 3, 0.5)
    assert got.count() == 36
    assert sum(w.meetings for w in waves) < 0.25 * waves[0].possible
    spark = asked.sparkSession
    plan = V._of_parts(spark.read.parquet(f"{path}/vectors"), [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "In(part, [1,2])" in plan


def test_empty_index_and_no_queries(spark, stored, tmp_path):
    _, _, asked, path = stored
    assert V.search_index(asked.limit(0), path, 3)[0].count() == 0
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    V.write_vector_index(empty, str(tmp_path / "e"), DIM)
    assert V.search_index(asked, str(tmp_path / "e"), 3)[0].count() == 0


def test_a_task_gives_few_rows_per_query(spark, tmp_path):
    """What a task has found for a query bounds what it gives of later parts: far less than k rows of every part."""
    from pictorium.operators import vector_index as V

    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1500, 12))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    V.write_vector_index(base, str(tmp_path / "index"), 12, pivots=60)
    stored = spark.read.parquet(str(tmp_path / "index/vectors")).coalesce(1)
    parts = [r[0] for r in stored.select("part").distinct().collect()]
    import pyarrow as pa

    ids = pa.array(range(1500))
    meets = {p: np.arange(1500) for p in parts}
    rows = V._meet(stored, meets, ids, unit, np.full(1500, 1e-12), 3, "query_id long, id long, similarity double").collect()
    best = {q: set(np.argsort(-(unit[q] @ unit.T))[:3].tolist()) for q in range(0, 1500, 50)}
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert all(best[q] <= got[q] for q in best) and len(rows) < 1500 * 3 * len(parts) / 3
