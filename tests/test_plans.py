"""Kernels against brute force on small inputs, with skew forced."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pictorium.plans import components, hamming, ordering, paths, skew, vector_join


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def near_words(seed, n, centres, flips):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(centres)]
    words = set()
    while len(words) < n:
        w = rng.choice(base)
        for _ in range(rng.randint(0, flips)):
            w ^= 1 << rng.randrange(64)
        words.add(w)
    return sorted(words)


def brute_pairs(words, t):
    out = set()
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if bin(a ^ b).count("1") <= t:
                x, y = sorted((signed(a), signed(b)))
                out.add((x, y, bin(a ^ b).count("1")))
    return out


@pytest.mark.parametrize("radius", [0, 1, 3, 6, 10, 19])
@pytest.mark.parametrize("limit", [4000, 20, 3])
def test_hamming_pairs_equal_brute_force(spark, radius, limit):
    words = near_words(radius, 250, 6, 9)
    df = spark.createDataFrame([(signed(w),) for w in words], "word long")
    layout = hamming.Layout(radius + 1, radius) if radius < 12 else "auto"
    got = [tuple(r) for r in hamming.hamming_pairs(df, radius, bucket_limit=limit, layout=layout).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs(words, radius)


def test_hamming_hot_band(spark):
    # a third of the words share their upper 40 bits
    rng = random.Random(5)
    words = {(0xABCDEF1234 << 24) | rng.getrandbits(24) for _ in range(120)} | {rng.getrandbits(64) for _ in range(240)}
    words = sorted(words)
    df = spark.createDataFrame([(signed(w),) for w in words], "word long")
    for layout in (hamming.Layout(8, 6), hamming.Layout(9, 6), None):
        got = {tuple(r) for r in hamming.hamming_pairs(df, 6, bucket_limit=15, layout=layout).collect()}
        assert got == brute_pairs(words, 6)


def test_hamming_neighbours(spark):
    words = near_words(1, 150, 4, 8)
    asked = near_words(1, 40, 4, 8)
    df = spark.createDataFrame([(signed(w),) for w in words], "word long")
    q = spark.createDataFrame([(signed(w),) for w in asked], "word long")
    want = {
        (signed(a), signed(b), bin(a ^ b).count("1")) for a in asked for b in words if bin(a ^ b).count("1") <= 5
    }
    for limit in (4000, 4):
        got = [tuple(r) for r in hamming.hamming_neighbours(q, df, 5, bucket_limit=limit).collect()]
        assert len(got) == len(want) and set(got) == want


def test_layout_grows_with_rows():
    assert hamming.choose_layout(1000, 6) is None or hamming.choose_layout(1000, 6).bands >= 7
    wide = hamming.choose_layout(10**9, 6)
    assert wide.bands > 7 and len(wide.keys) <= hamming.MAX_KEYS


@pytest.mark.parametrize("hot", [skew.HOT_ROWS, 5])
def test_components_equal_union_find(spark, hot):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]  # a chain
    edges += [(2000, 2001 + i) for i in range(80)]  # a hub
    edges += [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    nodes = sorted({x for e in edges for x in e} | {5000})
    want = {n: find(n) for n in nodes}
    df = spark.createDataFrame(edges, "src long, dst long")
    nd = spark.createDataFrame([(n,) for n in nodes], "node long")
    got = {r["node"]: r["component"] for r in components.connected_components(df, nd, hot_rows=hot).collect()}
    assert got == want


def test_shortest_path(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("x", "y")], "src string, dst string")
    assert [tuple(r) for r in paths.shortest_path(edges, "a", "d").collect()] == [(0, "a"), (1, "d")]
    assert [r["node"] for r in paths.shortest_path(edges, "b", "d").orderBy("step").collect()] == ["b", "a", "d"]
    assert paths.shortest_path(edges, "a", "x").count() == 0
    assert paths.shortest_path(edges, "a", "a").count() == 1


@pytest.mark.parametrize("span", [4, 1 << 20])
def test_number_within_and_latest_before(spark, span):
    rng = random.Random(9)
    rows = [(rng.choice("abbbbb"), i, rng.random() < 0.4) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o long, base boolean")
    want_n, want_p, seen, last = {}, {}, {}, {}
    for k, o, b in rows:
        seen[k] = seen.get(k, 0) + 1
        want_n[o] = seen[k]
        want_p[o] = last.get(k)
        if b:
            last[k] = o
    got = ordering.number_within(df, ["k"], "o", "n", span=span)
    assert {r["o"]: r["n"] for r in got.collect()} == want_n
    got = ordering.latest_before(df, ["k"], "o", "base", "prev", span=span)
    assert {r["o"]: r["prev"] for r in got.collect()} == want_p


def test_number_all(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    rows = ordering.number_all(df, ["x"], "n").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1000))
    assert [r["x"] for r in rows] == sorted(r["x"] for r in rows)


def test_lookup_join_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = skew.lookup_join(rows, table, ["k"], 3000, hot_rows=10)
    assert got.count() == 3000 and got.filter(F.col("v") != F.col("k") * 2).count() == 0


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    which = rng.choice(5, size=n, p=[0.5, 0.2, 0.1, 0.1, 0.1])
    return (centres[which] + 0.6 * rng.normal(size=(n, d))).astype("float32")


@pytest.mark.parametrize("block,pivots", [(4096, None), (16, None), (8, 3), (16, 1)])
def test_cosine_pairs_equal_brute_force(spark, block, pivots):
    m = vectors(120, 8, 2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, [0.0] * 8), (901, [])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    u = m.astype("float64")
    u /= np.linalg.norm(u, axis=1)[:, None]
    sims = u @ u.T
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if sims[i, j] >= 0.8}
    got = vector_join.cosine_pairs(df, 0.8, block=block, pivots=pivots).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    assert all(abs(r["similarity"] - sims[r["a"], r["b"]]) < 1e-9 for r in got)


@pytest.mark.parametrize("numbers,block", [(10**6, 4096), (10, 16)])
def test_cosine_topk_equal_brute_force(spark, numbers, block):
    m = vectors(90, 8, 4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = df.filter("id < 30").withColumnRenamed("id", "query_id")
    u = m.astype("float64")
    u /= np.linalg.norm(u, axis=1)[:, None]
    sims = u @ u.T
    want = {
        (i, int(j), r + 1)
        for i in range(30)
        for r, j in enumerate([j for j in np.argsort(-sims[i], kind="stable") if sims[i, j] >= 0.2][:4])
    }
    got = vector_join.cosine_topk(q, df, 4, 0.2, max_numbers=numbers, block=block).collect()
    assert {(r["query_id"], r["id"], r["rank"]) for r in got} == want


def test_hamming_pairs_are_never_broadcast(spark):
    # exploded keys look as small as their words, so Catalyst would send them through the driver
    words = near_words(11, 3000, 40, 9)
    df = spark.createDataFrame([(signed(w), 1 + i % 3) for i, w in enumerate(words)], "word long, n long")
    for limit in (16384, 50):
        found = hamming.hamming_pairs(df, 6, bucket_limit=limit, layout=hamming.Layout(7, 6), rows=len(words), count="n")
        rows = found.collect()
        assert {tuple(r)[:3] for r in rows} == brute_pairs(words, 6) and len(rows) == len({tuple(r) for r in rows})
        n = {signed(w): 1 + i % 3 for i, w in enumerate(words)}
        assert all((r["n_a"], r["n_b"]) == (n[r["a"]], n[r["b"]]) for r in rows)
        if limit > len(words):
            assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    asked = hamming.hamming_neighbours(df.select("word"), df, 6, layout=hamming.Layout(7, 6))
    assert "BroadcastExchange" not in asked._jdf.queryExecution().executedPlan().toString()


def test_topk_keeps_k_rows_a_query_and_task(spark):
    # every vector is like a zero vector with 0: of so many ties only the first k may leave a task
    m = vectors(600, 6, 5)
    m[::3] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>").repartition(3)
    q = df.filter("id < 60").withColumnRenamed("id", "query_id")
    u = m.astype("float64")
    u /= np.maximum(np.linalg.norm(u, axis=1), 1e-12)[:, None]
    sims = u @ u.T
    want = {(i, int(j), r + 1) for i in range(60) for r, j in enumerate([j for j in np.argsort(-np.round(sims[i], 9), kind="stable") if sims[i, j] >= 0][:40])}
    for options in ({"tile": 16}, {"tile": 16, "max_numbers": 1, "block": 32}):
        got = vector_join.cosine_topk(q, df, 40, 0.0, **options)
        assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == want
    found = []
    for at in range(0, 600, 200):
        found.append(int(vector_join._k_best(sims[:60, at : at + 200], 40).sum()))
    assert max(found) < 2 * 40 * 60  # 67 ties alone for each of 20 zero vectors


def test_stripes_move_vectors_to_few_tasks():
    n, d = 60_000, 65
    p, q = vector_join._grid((n, n * d), (n, n * d), 3, 256, 48)
    assert p * q >= 48 and p + q <= 16  # blocks of 256 rows sent each vector to 235 tasks
    assert vector_join._grid((24_000, 24_000 * d), (n, n * d), 300, 4096, 48)[1] <= 4
    assert math.ceil(n / vector_join._self_stripe(n, 64, 200, 48)) <= 10 and vector_join._self_stripe(10, 64, 200, 48) == 200
    # full stripes bound the memory of a task
    assert vector_join._self_stripe(10**8, 64, 200, 48) * 64 <= vector_join.STRIPE_NUMBERS


def test_cells_are_left_where_no_clusters_are(spark, monkeypatch):
    """Vectors in all directions would visit half of the cells: they go to stripes, with the same pairs.  Near few pivots cells pay."""
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    spread, centres = unit(rng.normal(size=(600, 24))), unit(rng.normal(size=(30, 24)))
    assert not vector_join._pivots_pay(centres, spread, 1.0, 3)
    assert vector_join._pivots_pay(centres, unit(np.repeat(centres, 5, 0) + 0.001 * rng.normal(size=(150, 24))), 0.4, 3)
    placed = []
    place = vector_join._place_in_cells
    monkeypatch.setattr(vector_join, "_place_in_cells", lambda *a: placed.append(1) or place(*a))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(spread)], "id long, embedding array<double>")
    got = {(r["a"], r["b"]) for r in vector_join.cosine_pairs(df, 0.5, block=20).collect()}
    assert not placed and got == {(i, j) for i, j in np.argwhere(np.triu(spread @ spread.T, 1) >= 0.5).tolist()}
