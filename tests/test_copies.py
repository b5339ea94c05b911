"""Graph queries over vectors with copies: every pair that meets the threshold is a link, whatever group it is in."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from oracle import compare
from pictorium.checks import ENTRIES
from pictorium.operators import graph

QUERIES = [
    "a5_load_graph", "b4_save_graph", "j3_semantic_edges", "j3_semantic_edges_blocks", "j6_connected_components", "j6_components_after", "j7_component_stats",
    "j8_degrees", "j9_neighbours_many", "j9_stored_neighbours", "j10_shortest_path", "j11_graph_stats", "j12_scans", "j14_build_graph",
]


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """60 documents; vectors 0, 7, 14 … are one vector, 3, 13, 23 … another near it, and the first of the second group has no node."""
    root, rng = tmp_path_factory.mktemp("copies"), np.random.default_rng(4)
    n = 60
    source = [f"src{3 if i == 3 else (0, 1, 2, 4, 6, 8, 9, 12)[i % 8]}" for i in range(n)]
    docs = {"doc_id": list(range(n)), "text": [f"text {i}" for i in range(n)], "lang": [("en", "de", "fr")[i % 3] for i in range(n)], "source": source, "n_chars": [6] * n}
    vectors = rng.normal(size=(n, 16)).astype("float32")
    vectors[::7] = vectors[0]
    vectors[3::10] = vectors[0] + rng.normal(size=16).astype("float32") / 2
    labels = {"doc_id": list(range(0, n, 4)), "quality": [1] * (n // 4), "toxic": [i % 2 for i in range(n // 4)]}
    for name, columns in (("documents", docs), ("labels", labels), ("embeddings", {"vec_id": list(range(n)), "embedding": vectors.tolist(), "label": [0] * n})):
        table = pa.table(columns)
        if name == "embeddings":
            table = table.set_column(1, "embedding", table["embedding"].cast(pa.list_(pa.float32())))
        pq.write_table(table, f"{root}/{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return str(root), con


@pytest.mark.parametrize("name", QUERIES)
def test_query_over_copies_equals_sql(spark, copies, name):
    root, con = copies
    problem, *_ = compare(spark, con, root, ENTRIES[name].run, ENTRIES[name].sql)
    assert not problem


def links(edges):
    return sorted((r["source_id"], r["target_id"], r["weight"]) for r in edges.collect())


def test_all_pairs_of_copies_are_edges(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.8, 0.6]) for i in range(9)] + [(20, [0.0, 0.0]), (21, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = links(graph.semantic_edges(vectors, 0.7, stars=False))
    assert [(a, b) for a, b, _ in got] == sorted((f"img_{a}", f"img_{b}") for a in range(9) for b in range(a + 1, 9))
    # copies have the weight 1, and the pairs of two groups the same weight
    assert {w for a, b, w in got if (int(a[4:]) % 3 > 0) == (int(b[4:]) % 3 > 0)} == {1.0} and len({w for *_, w in got}) == 2
    assert links(graph.semantic_edges(vectors.unionByName(vectors), 0.7, stars=False)) == got  # a row that comes again
    assert len(links(graph.semantic_edges(vectors, 1.0, stars=False))) == 3 + 15


def test_copies_keep_their_links_without_the_first(spark):
    # 3 is a copy of 1, whose node is not shown
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0]), (4, [0.9, 0.2]), (5, [0.9, 0.2])], "id long, embedding array<double>")
    known = spark.createDataFrame([(f"img_{i}",) for i in (2, 3, 4, 5)], "id string")
    got = links(graph.semantic_edges(vectors, 0.5, known, stars=False))
    assert [(a, b) for a, b, _ in got] == [(f"img_{a}", f"img_{b}") for a in range(2, 6) for b in range(a + 1, 6)]


def test_paths_between_copies_take_one_step(spark):
    rows = [(i, f"/x/{i}.jpg", "completed", [], None, None) for i in (1, 2, 3)]
    assets = spark.createDataFrame(rows, "id long, file_path string, ai_status string, ai_tags array<string>, ai_description string, ai_category string")
    g = graph.build_graph(assets, spark.createDataFrame([(i, [1.0, 0.0]) for i in (1, 2, 3)], "id long, embedding array<double>"))
    assert graph.path_length(g.edges, "img_2", "img_3").head()["length"] == 1


def test_copies_have_the_same_similarity_in_every_stripe(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 37))
    rows = [(i, base[i % 6].tolist()) for i in range(240)]
    pairs = graph.linked_pairs(spark.createDataFrame(rows, "id long, embedding array<double>"), 0.05, block=7, pivots=3).collect()
    seen = {}
    for r in pairs:
        seen.setdefault(frozenset((r["a"] % 6, r["b"] % 6)), []).append(r["similarity"])
    assert all(len(set(s)) == 1 for s in seen.values()) and all(set(s) == {1.0} for k, s in seen.items() if len(k) == 1)
    assert all(len(s) == (1600 if len(k) == 2 else 780) for k, s in seen.items())
