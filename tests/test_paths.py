"""Two-sided path search and the stored adjacency against plain walks."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from pictorium.operators import graph as J
from pictorium.plans.paths import shortest_path


def distance(edges, a, b):
    near = {}
    for x, y in edges:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    seen, todo = {a: 0}, deque([a])
    while todo:
        x = todo.popleft()
        for y in near.get(x, ()):
            if y not in seen:
                seen[y] = seen[x] + 1
                todo.append(y)
    return seen.get(b)


@pytest.mark.parametrize("seed,n,m", [(1, 30, 28), (2, 30, 45), (3, 60, 75)])
def test_shortest_paths_in_random_graphs(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
    frame = spark.createDataFrame(edges + edges[:3], "src string, dst string")
    links = {frozenset(e) for e in edges}
    for _ in range(4):
        a, b = rng.sample(range(n), 2)
        a, b = f"n{a}", f"n{b}"
        want = distance(edges, a, b)
        path = [r["node"] for r in shortest_path(frame, a, b).orderBy("step").collect()]
        if want is None:
            assert path == []
            continue
        assert (path[0], path[-1], len(path)) == (a, b, want + 1)
        assert all(frozenset(h) in links for h in zip(path, path[1:]))
        assert shortest_path(frame, a, b, want - 1).count() == 0 and shortest_path(frame, a, b, want).count() == want + 1


def test_smaller_side_grows(spark):
    """The source lies in a wide tree, the target on a thin chain: the search walks the chain."""
    edges = [("root", f"a{i}") for i in range(40)] + [(f"a{i}", f"b{i}.{j}") for i in range(40) for j in range(10)]
    edges += [("root", "c0")] + [(f"c{i}", f"c{i + 1}") for i in range(6)]
    trace = []
    path = shortest_path(spark.createDataFrame(edges, "src string, dst string"), "root", "c6", trace=trace)
    assert path.count() == 8
    assert sum(x.nodes for x in trace) < 60  # a one-sided search would touch 450


def test_stored_adjacency(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, f"n{a}", f"n{b}", rng.choice(["semantic", "tag_overlap"]), float(rng.randint(1, 9))) for k, (a, b) in enumerate((rng.randrange(200), rng.randrange(200)) for _ in range(900)) if a != b]
    rows += [(10_000 + i, "hub", f"n{i % 200}", "custom", 1.0 + i % 7) for i in range(600)]
    edges = spark.createDataFrame(rows, "id long, source_id string, target_id string, edge_type string, weight double")
    nodes = spark.createDataFrame([(f"n{i}", "image", f"l{i}") for i in range(200)] + [("hub", "tag", "hub")], "id string, node_type string, label string")
    J.write_adjacency(edges, str(tmp_path / "adj"))
    stored = J.read_adjacency(spark, str(tmp_path / "adj"))
    columns = ["node", "neighbour", "edge_type", "weight"]
    assert sorted(map(tuple, stored.select(columns).collect())) == sorted(map(tuple, J.both_ways(edges).select(columns).collect()))
    for node, types, limit in (("n7", None, 5), ("hub", None, 9), ("hub", ["semantic"], None), ("nobody", None, 3)):
        assert J.stored_neighbours(nodes, stored, node, types, limit).collect() == J.neighbours(nodes, edges, node, types, limit).collect()
    plan = stored.filter(F.col("node") == "n7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(node,n7)" in plan and "Exchange" not in plan
    # files hold disjoint ranges of nodes, but for a hub's, so a lookup opens few
    spans = stored.select(F.input_file_name().alias("f"), "node").groupBy("f").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).collect()
    assert len(spans) > 2 and sum(s["lo"] <= "n7" <= s["hi"] for s in spans) <= 2


def labels_of(nodes, edges):
    label = {n: n for n in nodes}
    for a, b in edges:
        x, y = sorted((label.setdefault(a, a), label.setdefault(b, b)))
        label = {n: x if v == y else v for n, v in label.items()}
    return label


@pytest.mark.parametrize("seed,hot", [(1, 10**6), (2, 10**6), (3, 2)])
def test_components_after_changes_equal_a_rebuild(spark, seed, hot):
    from pictorium.plans.components import connected_components, update_components

    rng = random.Random(seed)
    pair = lambda: tuple(sorted(rng.sample([f"n{i:02d}" for i in range(80)], 2)))
    edges = {pair() for _ in range(70)} | {("n00", f"n{i:02d}") for i in range(30, 45)}
    frame = lambda rows: spark.createDataFrame(sorted(rows), "src string, dst string")
    labels = connected_components(frame(edges), hot_rows=hot)
    for _ in range(2):
        gone = set(rng.sample(sorted(edges), 6)) | {("n00", "n30")} & edges
        come = {pair() for _ in range(5)} | {("x1", "x2"), ("n05", "x1")}
        edges = (edges - gone) | come
        labels = update_components(labels, frame(edges), frame(come), frame(gone), hot_rows=hot)
        got = {r["node"]: r["component"] for r in labels.collect()}
        want = labels_of(set(got), edges)
        assert got == want
    assert update_components(labels, frame(edges), frame(edges).limit(0), frame(edges).limit(0)).count() == len(got)


def test_paths_do_not_move_edges(spark, monkeypatch):
    """Many edges, few of them at a level: what is written and shuffled is levels, with the smallest parent of each node."""
    from pictorium.plans import paths

    written = []

    class Watched(paths.Scratch):
        def write(self, df, **metrics):
            table, seen = super().write(df, **metrics)
            written.append((df.columns, table.count(), df._jdf.queryExecution().executedPlan().toString()))
            return table, seen

    monkeypatch.setattr(paths, "Scratch", Watched)
    pairs = [("s", f"m{i}") for i in (9, 3, 5)] + [(f"m{i}", "t") for i in (9, 5)] + [("m9", "m3"), ("m9", "t")] + [(f"x{i % 97}", f"y{i}") for i in range(3000)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    assert [r["node"] for r in shortest_path(edges, "s", "t").orderBy("step").collect()] == ["s", "m5", "t"]
    assert [r["node"] for r in shortest_path(edges, "m3", "t").orderBy("step").collect()] == ["m3", "m9", "t"]
    assert all(columns == ["node", "rank", "parent"] for columns, _, _ in written) and sum(n for _, n, _ in written) < 20
    assert not any("SortAggregate" in plan or "SortMergeJoin" in plan for *_, plan in written)


def test_leaves_that_nobody_asks_for_are_not_moved(spark):
    from pictorium.plans.components import _stars, _without_leaves, connected_components

    rng = random.Random(8)
    pairs = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)]
    pairs += [(f"n{rng.randrange(60):02d}", f"x{i:04d}") for i in range(1500)]  # each has one edge
    pairs += [("n01", "a0"), ("a0", "x0000"), ("n02", "y"), ("n03", "y"), ("n04", "z"), ("n04", "z"), ("m1", "m2")]  # a first name, links between asked nodes
    nodes = sorted({n for p in pairs for n in p if n[0] == "n"}) + ["alone"]
    frame = spark.createDataFrame(pairs, "src string, dst string").repartition(7)
    start = frame.filter("src != dst").selectExpr("greatest(src, dst) AS u", "least(src, dst) AS v")
    asked = spark.createDataFrame([(n,) for n in nodes], "node string")
    assert _stars(start).distinct().count() > 1500 and _without_leaves(_stars(start, centres=True), asked).count() < 500
    want = labels_of(nodes, pairs)
    for others in (True, False):
        assert {r["node"]: r["component"] for r in connected_components(frame, asked, others=others).collect()} == {n: want[n] for n in nodes}


@pytest.mark.parametrize("share", [0.1, 0.9])
def test_changes_move_few_edges(spark, share):
    """Components that lose an edge hold few nodes or most: the labels are those of a rebuild."""
    from pictorium.plans.components import _maybe_among, update_components

    groups = [[f"g{g:02d}.{i}" for i in range(6)] for g in range(30)]
    edges = {(a, b) for g in groups for a, b in zip(g, g[1:])}
    frame = lambda rows: spark.createDataFrame(sorted(rows), "src string, dst string")
    gone = {(g[2], g[3]) for g in groups[: round(30 * share)]}
    old = labels_of([n for g in groups for n in g], edges)
    come = {("g00.1", "g29.1"), ("g05.4", "g07.5"), ("new", "g07.0"), ("p", "q"), ("new", "a")}
    after = (edges - gone) | come
    labels = spark.createDataFrame(sorted(old.items()), "node string, component string")
    never = {(a, f"no{i:05d}") for i, (a, _) in enumerate(sorted(gone) * 300)}  # ends without a label
    got = update_components(labels, frame(after), frame(come), frame(gone | never)).collect()
    want = labels_of(old, after)
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    rows = spark.createDataFrame([(f"no{i:05d}",) for i in range(3000)] + [(n,) for n in old], "node string")
    kept = {r["node"] for r in _maybe_among(rows, ["node"], labels, len(old)).collect()}
    assert set(old) <= kept and len(kept) < 600
