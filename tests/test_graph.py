import pytest

from pictorium.operators import graph
from pictorium.sources import sinks, tables


def nodes(spark, *ids):
    rows = [(i, "image", i, [], None, None, None) for i in ids]
    return spark.createDataFrame(rows, "id string, node_type string, label string, tags array<string>, description string, category string, tag_count long")


def edges(spark, *pairs, kind="semantic"):
    rows = [(f"{a}-{b}-{kind}", a, b, kind, w) for a, b, w in pairs]
    return spark.createDataFrame(rows, "id string, source_id string, target_id string, edge_type string, weight double")


def test_neighbours(spark):
    n, e = nodes(spark, "a", "b", "c"), edges(spark, ("a", "b", 0.8), ("b", "c", 0.9))
    assert [r["id"] for r in graph.neighbours(n, e, "a").collect()] == ["b"]
    assert [(r["id"], r["weight"]) for r in graph.neighbours(n, e, "b").collect()] == [("c", 0.9), ("a", 0.8)]
    assert [r["id"] for r in graph.neighbours(n, e, "b", limit=1).collect()] == ["c"]
    assert graph.neighbours(n, e, "a", ["tag_overlap"]).isEmpty()
    odd = edges(spark, ("a", "c", 0.1), kind="custom")
    assert [r["id"] for r in graph.neighbours(n, odd, "a", ["who knows"]).collect()] == ["c"]


def test_paths(spark):
    e = edges(spark, ("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "d", 0.5))
    assert graph.path_length(e, "a", "d").head()["length"] == 1
    assert graph.path_length(e, "a", "e").head()["length"] is None
    assert graph.path_length(e, "a", "a").head()["length"] == 0
    path = graph.shortest_path(e, "b", "d")
    total = graph.path_edges(e, path).orderBy("step").collect()
    assert [r["to_id"] for r in total] == ["a", "d"] and total[-1]["total_weight"] == 1.5


def test_stats(spark):
    n, e = nodes(spark, "a", "b", "c"), edges(spark, ("a", "b", 0.8))
    parts = graph.components(n, e)
    stats = {(r["section"], r["name"]): r["value"] for r in graph.graph_stats(n, e, parts).collect()}
    assert stats[("total", "nodes")] == 3 and stats[("total", "edges")] == 1 and stats[("total", "communities")] == 2
    assert abs(stats[("total", "density")] - 1 / 3) < 1e-9 and stats[("total", "diameter")] is None
    assert stats[("node_type", "image")] == 3 and stats[("edge_type", "semantic")] == 1
    empty = graph.graph_stats(n.limit(0), e.limit(0), parts.limit(0))
    assert {r["name"]: r["value"] for r in empty.collect()}["avg_degree"] == 0


def test_build_save_load_clear(spark, tmp_path):
    rows = [
        (1, "/x/1.jpg", "completed", ["red", "car"], "d1", "object"),
        (2, "C:\\x\\2.jpg", "completed", ["red"], "d2", None),
        (3, "/x/3.jpg", "completed", ["lonely"], None, "animal"),
        (4, "/x/4.jpg", "pending", ["red"], None, None),
    ]
    assets = spark.createDataFrame(rows, "id long, file_path string, ai_status string, ai_tags array<string>, ai_description string, ai_category string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0])], "id long, embedding array<float>")
    g = graph.build_graph(assets, vectors)
    assert {r["id"]: r["label"] for r in g.nodes.collect()} == {"img_1": "1.jpg", "img_2": "2.jpg", "img_3": "3.jpg", "tag_red": "red"}
    assert {r["id"] for r in g.edges.collect()} == {"img_1-img_2-semantic", "img_1-tag_red-tag_overlap", "img_2-tag_red-tag_overlap"}
    root = str(tmp_path / "g")
    assert sinks.save_graph(g, root).head()["n_rows"] == 4 + 3 + 2
    loaded = tables.load_graph(spark, root)
    stored = {r["id"]: r for r in loaded["nodes"].collect()}
    assert stored["img_1"]["properties"]["category"] == "object" and stored["tag_red"]["properties"]["count"] == "2"
    assert stored["img_1"]["degree"] == 2 and stored["img_1"]["community_id"] == stored["tag_red"]["community_id"] == 0
    communities = {r["id"]: r for r in loaded["communities"].collect()}
    assert communities[0]["size"] == 3 and communities[0]["density"] == 1.0 and communities[0]["central_node_id"] == "img_1"
    assert communities[1]["size"] == 1 and communities[1]["central_node_id"] is None
    assert loaded["adjacency"].count() == 6
    assert sinks.clear_graph(g, root).head()["n_rows"] == 0


def test_bad_properties_become_empty(spark, tmp_path):
    for name in ("kg_nodes", "kg_edges", "kg_communities"):
        spark.createDataFrame([("a", "b", "c", "t", 1.0, "{broken")], "id string, source_id string, target_id string, edge_type string, weight double, properties string").write.parquet(str(tmp_path / name))
    assert tables.load_graph(spark, str(tmp_path))["nodes"].head()["properties"] == {}


@pytest.mark.parametrize("hot", [1, 10**6])
def test_tag_edges_with_a_hot_tag(spark, hot):
    rows = [(i, f"/x/{i}.jpg", "completed", ["all", f"t{i % 7}"], None, None) for i in range(60)]
    assets = spark.createDataFrame(rows, "id long, file_path string, ai_status string, ai_tags array<string>, ai_description string, ai_category string")
    images = graph.image_nodes(assets)
    got = graph.tag_edges(images, graph.tag_nodes(images), hot_rows=hot)
    want = {(f"img_{i}", f"tag_{t}") for i, _, _, tags, _, _ in rows for t in tags}
    assert got.count() == len(want) and {(r["source_id"], r["target_id"]) for r in got.collect()} == want


def test_copies_hang_on_the_first(spark):
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [0.8, 0.6]) for i in range(9)] + [(20, [0.0, 0.0]), (21, [0.0, 0.0])], "id long, embedding array<float>")
    got = {(r["source_id"], r["target_id"], round(r["weight"], 6)) for r in graph.semantic_edges(vectors, 0.7).collect()}
    assert got == {("img_0", "img_1", 0.8), ("img_0", "img_3", 1.0), ("img_0", "img_6", 1.0)} | {("img_1", f"img_{i}", 1.0) for i in (2, 4, 5, 7, 8)}


def test_semantic_edges_of_known_nodes(spark):
    # 3 is a copy of 1, whose node is not shown: only edges between shown nodes stay, whatever a group's first is
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0]), (4, [0.9, 0.2]), (5, [0.9, 0.2])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    known = spark.createDataFrame([(f"img_{i}",) for i in (2, 3, 4, 5)], "id string")
    every = graph.semantic_edges(vectors, 0.5).filter("source_id != 'img_1' and target_id != 'img_1'")
    some = graph.semantic_edges(vectors, 0.5, known)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.collect())) and some.count() == 2
    assert graph.semantic_pairs(vectors, 0.5, known).pairs.count() == 1  # vectors without a node do not meet


def test_degrees_move_an_edge_once(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "a", "x"), ("a", "b", "y"), ("a", "a", "x"), ("c", "a", "x")], "source_id string, target_id string, edge_type string").selectExpr("*", "1.0D weight")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    found = graph.degrees(nodes, edges)
    assert {tuple(r) for r in found.collect()} == {("a", 4), ("b", 2), ("c", 1), ("d", 0)}
    assert "Union" not in found._jdf.queryExecution().executedPlan().toString()


def test_stored_semantic_edges_are_not_shuffled(spark):
    rows = [(i, f"/x/{i}.jpg", "completed", ["all", f"t{i % 3}"], None, None) for i in range(12)]
    assets = spark.createDataFrame(rows, "id long, file_path string, ai_status string, ai_tags array<string>, ai_description string, ai_category string")
    vectors = spark.createDataFrame([(i, [1.0, i / 20]) for i in range(12)], "id long, embedding array<double>")
    g = graph.build_graph(assets, vectors, 0.9)
    want = graph.semantic_edges(vectors, 0.9)
    semantic = graph.filter_edges(g.edges, ("semantic",))
    assert sorted(map(tuple, semantic.collect())) == sorted(map(tuple, want.select(*semantic.columns).collect()))
    found = graph.degrees(g.nodes, g.edges, g.simple)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, graph.degrees(g.nodes, g.edges).collect()))
    keys = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert keys and not any("low" in line for line in keys)  # ends are moved added up by node, edges are not
    # an id of two vectors: its pairs meet twice and stay once
    again = vectors.unionByName(vectors.filter("id = 3").selectExpr("id", "array(1.0D, 0.51D) AS embedding"))
    twice = graph.build_graph(assets, again, 0.9)
    ends = [(r["source_id"], r["target_id"]) for r in graph.filter_edges(twice.edges, ("semantic",)).collect()]
    assert len(ends) == len(set(ends)) and set(ends) >= {(r["source_id"], r["target_id"]) for r in semantic.collect()}


def test_components_begin_with_stars(spark):
    from pictorium.plans.components import _stars

    # complete graphs and a hub: of the edges of a task at most one per node is left
    pairs = [(f"n{b:03d}", f"n{a:03d}") for k in range(3) for a in range(k * 30, k * 30 + 30) for b in range(a + 1, k * 30 + 30)]
    pairs += [(f"x{i:05d}", "a") for i in range(5000)] + [("z", f"x{i:05d}") for i in range(5000)]
    edges = spark.createDataFrame(pairs, "u string, v string").coalesce(1)
    got = sorted(map(tuple, _stars(edges).collect()))
    want = [(f"n{i:03d}", f"n{i // 30 * 30:03d}") for i in range(90) if i % 30] + [(f"x{i:05d}", "a") for i in range(5000)] + [("z", "a")]
    assert got == sorted(want)
    assert _stars(edges.limit(0)).isEmpty()
