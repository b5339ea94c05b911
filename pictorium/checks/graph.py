"""Graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pictorium.operators import graph as J
from pictorium.plans.scratch import materialize
from pictorium.plans.scratch import new_path
from pictorium.sources import adapters as A

from .registry import check, view, with_views

THRESHOLD = 0.35

view("image_nodes", """
    SELECT 'img_' || id AS id, 'image' AS node_type, file_name AS label, ai_tags AS tags, ai_description AS description, ai_category AS category
    FROM assets WHERE ai_status = 'completed'""", "assets")
view("tag_nodes", """
    SELECT 'tag_' || tag AS id, 'tag' AS node_type, tag AS label, count(*) AS tag_count FROM (SELECT unnest(tags) AS tag FROM image_nodes)
    GROUP BY tag HAVING count(*) >= 2""", "image_nodes")
view("sem_all", f"""
    SELECT 'img_' || a.vec_id AS source_id, 'img_' || b.vec_id AS target_id, 'semantic' AS edge_type,
      list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS weight
    FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
    WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {THRESHOLD}""")
view("tag_links", """
    SELECT i.id AS source_id, t.id AS target_id, 'tag_overlap' AS edge_type, CAST(1.0 AS DOUBLE) AS weight
    FROM (SELECT DISTINCT id, unnest(tags) AS tag FROM image_nodes) i JOIN tag_nodes t ON t.label = i.tag""", "image_nodes", "tag_nodes")
view("nodes", """
    SELECT id, node_type, label, description, category FROM image_nodes
    UNION ALL SELECT id, node_type, label, NULL, NULL FROM tag_nodes""", "image_nodes", "tag_nodes")
view("edges", """
    SELECT * FROM tag_links UNION ALL
    SELECT * FROM sem_all WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)""", "tag_links", "sem_all", "nodes")
view("links", """
    SELECT source_id AS node, target_id AS neighbour, edge_type, weight FROM edges
    UNION ALL SELECT target_id, source_id, edge_type, weight FROM edges""", "edges")
# components over the semantic edges alone keep many separate parts
view("sem_edges", "SELECT * FROM edges WHERE edge_type = 'semantic'", "edges")
_PARTS = """
    hop(id, root) AS (SELECT id, id FROM nodes WHERE node_type = 'image' UNION
      SELECT l.neighbour, h.root FROM hop h JOIN (SELECT source_id AS node, target_id AS neighbour FROM sem_edges
        UNION ALL SELECT target_id, source_id FROM sem_edges) l ON l.node = h.id),
    parts AS MATERIALIZED (SELECT id, min(root) AS component FROM hop GROUP BY id)"""


def parts_sql(body: str) -> str:
    return with_views("sem_edges, nodes, image_nodes", f"WITH {_PARTS} {body}", recursive=True)


def _graph(spark, d):
    return J.build_graph(A.assets(spark, d), A.vectors(spark, d).select("id", "embedding"), THRESHOLD)


def _semantic(spark, d):
    """Image nodes and the semantic edges between them."""
    g = _graph(spark, d)
    nodes, edges = g.nodes.filter("node_type = 'image'"), J.filter_edges(g.edges, ("semantic",))
    return nodes, edges


@check("j1_image_nodes", with_views("image_nodes", "SELECT id, node_type, label, array_to_string(tags, '|') AS tags, category, md5(description) AS digest FROM image_nodes"))
def image_nodes(spark, d):
    out = J.image_nodes(A.assets(spark, d))
    return out.select("id", "node_type", "label", F.array_join("tags", "|").alias("tags"), "category", F.md5(F.col("description").cast("binary")).alias("digest"))


@check("j2_tag_nodes", with_views("tag_nodes", "SELECT id, label, tag_count FROM tag_nodes"))
def tag_nodes(spark, d):
    return J.tag_nodes(J.image_nodes(A.assets(spark, d))).select("id", "label", "tag_count")


@check("j3_semantic_edges", with_views("sem_all", "SELECT source_id || '-' || target_id || '-semantic' AS id, source_id, target_id, edge_type, round(weight, 6) AS weight FROM sem_all"))
def semantic_edges(spark, d):
    return J.semantic_edges(A.vectors(spark, d), THRESHOLD, stars=False).withColumn("weight", F.round("weight", 6))


@check("j3_semantic_edges_blocks", with_views("sem_all", "SELECT source_id, target_id, round(weight, 6) AS weight FROM sem_all"))
def semantic_edges_blocks(spark, d):
    out = J.semantic_edges(A.vectors(spark, d), THRESHOLD, stars=False, block=200, pivots=5)
    return out.select("source_id", "target_id", F.round("weight", 6).alias("weight"))


# every fourth vector again, every eighth scaled, every tenth empty or zero
view("planted", """
    SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    UNION ALL SELECT 1000000 + vec_id, CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id % 4 = 0
    UNION ALL SELECT 2000000 + vec_id, CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id % 4 = 0
    UNION ALL SELECT 3000000 + vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 2) FROM embeddings WHERE vec_id % 8 = 0""")
view("planted_pairs", f"""
    SELECT a.id, b.id AS neighbour, list_cosine_similarity(a.v, b.v) AS similarity FROM planted a JOIN planted b ON a.id <> b.id
    WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}""", "planted")


def _planted(spark, d):
    base = A.vectors(spark, d).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    again = base.filter("id % 4 = 0")
    scaled = base.filter("id % 8 = 0").select((F.col("id") + 3_000_000).alias("id"), F.transform("embedding", lambda x: x * 2).alias("embedding"))
    nothing = base.filter("id % 10 = 0").select((F.col("id") + 4_000_000).alias("id"), F.when(F.col("id") % 20 == 0, F.slice("embedding", 1, 0)).otherwise(F.transform("embedding", lambda x: x * 0)).alias("embedding"))
    copies = [again.select((F.col("id") + n * 1_000_000).alias("id"), "embedding") for n in (1, 2)]
    return base.unionByName(copies[0]).unionByName(copies[1]).unionByName(scaled).unionByName(nothing)


@check("j3_semantic_pairs_of_copies", with_views("planted_pairs", "SELECT id, neighbour, round(similarity, 6) AS similarity FROM planted_pairs"))
def semantic_pairs_of_copies(spark, d):
    out = J.expand_pairs(J.semantic_pairs(_planted(spark, d), THRESHOLD))
    return out.withColumn("similarity", F.round("similarity", 6))


@check("j3_degrees_of_copies", with_views("planted, planted_pairs", "SELECT p.id, count(n.neighbour) AS degree FROM planted p LEFT JOIN planted_pairs n ON n.id = p.id GROUP BY 1"))
def degrees_of_copies(spark, d):
    return J.pair_degrees(J.semantic_pairs(_planted(spark, d), THRESHOLD))


@check("j4_tag_edges", with_views("tag_links", "SELECT * FROM tag_links"))
def tag_edges(spark, d):
    images = J.image_nodes(A.assets(spark, d))
    return J.tag_edges(images, J.tag_nodes(images)).drop("id")


@check("j5_dedup_edges", with_views("tag_links", "SELECT source_id, target_id, edge_type, CAST(1.0 AS DOUBLE) AS weight FROM tag_links"))
def dedup_edges(spark, d):
    images = J.image_nodes(A.assets(spark, d))
    edges = J.tag_edges(images, J.tag_nodes(images))
    again = edges.withColumn("weight", F.lit(2.0)).withColumn("id", F.concat("id", F.lit("-again")))
    return J.dedup_edges(edges.unionByName(again)).drop("id")


PARTS = parts_sql("SELECT id, component, dense_rank() OVER (ORDER BY component) - 1 AS community_id FROM parts")


@check("j6_connected_components", PARTS)
def connected_components(spark, d):
    nodes, edges = _semantic(spark, d)
    parts = J.components(nodes, edges)
    return parts.join(J.number_components(parts), "id")


@check("j6_components_after", PARTS)
def components_after(spark, d):
    """The same from the components of another edge set: edges to nodes with even numbers are taken away, half of the others come."""
    nodes, edges = _semantic(spark, d)
    odd = F.substr("target_id", F.lit(5)).cast("long") % 2 == 1
    common = edges.filter(~odd | (F.xxhash64("id") % 2 == 0))
    gone = edges.filter(~odd).select(F.col("target_id").alias("source_id"), F.concat(F.lit("img_"), F.col("weight").cast("string")).alias("target_id"))
    before = common.select("source_id", "target_id").unionByName(gone)
    parts = materialize(J.components(nodes, before), "parts")
    added = edges.filter(odd & (F.xxhash64("id") % 2 != 0))
    after = J.components_after(parts, nodes, edges, added, gone)
    return after.join(J.number_components(after), "id")


@check("j7_component_stats", parts_sql("""
    SELECT p.component, count(*) AS size, round(CASE WHEN count(*) > 1 THEN coalesce(any_value(e.n), 0) / (count(*) * (count(*) - 1) / 2.0) ELSE 0 END, 9) AS density,
      CASE WHEN max(d.degree) > 0 THEN arg_min(p.id, struct_pack(a := -d.degree, b := p.id)) END AS central_node_id, any_value(t.n_tags) AS n_tags
    FROM parts p
    JOIN (SELECT n.id, count(DISTINCT l.neighbour) AS degree FROM nodes n LEFT JOIN (SELECT source_id AS node, target_id AS neighbour FROM sem_edges
      UNION ALL SELECT target_id, source_id FROM sem_edges) l ON l.node = n.id GROUP BY 1) d ON d.id = p.id
    LEFT JOIN (SELECT p.component, count(*) AS n FROM sem_edges e JOIN parts p ON p.id = e.source_id GROUP BY 1) e ON e.component = p.component
    LEFT JOIN (SELECT component, count(DISTINCT tag) AS n_tags FROM (SELECT p.component, unnest(i.tags) AS tag FROM image_nodes i JOIN parts p ON p.id = i.id) GROUP BY 1) t
      ON t.component = p.component GROUP BY p.component"""))
def component_stats(spark, d):
    nodes, edges = _semantic(spark, d)
    parts = J.components(nodes, edges)
    stats = J.component_stats(nodes, edges, parts, simple=True).withColumn("density", F.round("density", 9))
    tags = J.component_tags(nodes, parts).groupBy("component").agg(F.count(F.lit(1)).alias("n_tags"))
    return stats.join(tags, "component", "left")


@check("j8_degrees", with_views("nodes, links", """
    SELECT n.id, count(l.neighbour) AS degree FROM nodes n LEFT JOIN (SELECT DISTINCT node, neighbour, edge_type FROM links) l ON l.node = n.id GROUP BY 1"""))
def degrees(spark, d):
    g = _graph(spark, d)
    return J.degrees(g.nodes, g.edges, g.simple)


NEIGHBOURS = with_views("nodes, links", """
    (SELECT l.neighbour AS id, n.label, l.edge_type, round(l.weight, 6) AS weight, CAST(1 AS BIGINT) AS distance, 'all' AS part FROM links l JOIN nodes n ON n.id = l.neighbour
     WHERE l.node = 'img_7' ORDER BY l.weight DESC, l.neighbour, l.edge_type LIMIT 10)
    UNION ALL
    (SELECT l.neighbour, n.label, l.edge_type, round(l.weight, 6), 1, 'tags' FROM links l JOIN nodes n ON n.id = l.neighbour
     WHERE l.node = 'tag_src8' AND l.edge_type = 'tag_overlap')""")


@check("j9_neighbours", NEIGHBOURS)
def neighbours(spark, d):
    g = _graph(spark, d)
    one = J.neighbours(g.nodes, g.edges, "img_7", None, 10).withColumn("part", F.lit("all"))
    two = J.neighbours(g.nodes, g.edges, "tag_src8", ["tag_overlap", "no such type"]).withColumn("part", F.lit("tags"))
    return one.unionByName(two).select("id", "label", "edge_type", F.round("weight", 6).alias("weight"), "distance", "part")


@check("j9_stored_neighbours", NEIGHBOURS)
def stored_neighbours(spark, d):
    """The same from a stored adjacency."""
    g, path = _graph(spark, d), new_path(spark, "adjacency")
    J.write_adjacency(g.edges, path)
    stored = J.read_adjacency(spark, path)
    one = J.stored_neighbours(g.nodes, stored, "img_7", None, 10).withColumn("part", F.lit("all"))
    two = J.stored_neighbours(g.nodes, stored, "tag_src8", ["tag_overlap", "no such type"]).withColumn("part", F.lit("tags"))
    return one.unionByName(two).select("id", "label", "edge_type", F.round("weight", 6).alias("weight"), "distance", "part")


@check("j9_neighbours_many", with_views("links, nodes", """
    SELECT node, neighbour, edge_type, rank FROM (SELECT node, neighbour, edge_type, row_number() OVER (PARTITION BY node ORDER BY weight DESC, neighbour, edge_type) AS rank
      FROM links WHERE node IN (SELECT id FROM nodes)) WHERE rank <= 3"""))
def neighbours_many(spark, d):
    g = _graph(spark, d)
    out = J.neighbours_many(g.nodes.select(F.col("id").alias("node")), g.edges, 3)
    return out.select("node", "neighbour", "edge_type", F.col("rank").cast("long").alias("rank"))


def _path_sql(name, source, target):
    return f"""SELECT '{name}' AS route, (SELECT min(depth) FROM walk WHERE start = '{source}' AND node = '{target}') AS length"""


# a tree of all orders below their customers, nations and regions: the only path between the first and the last order
_TREE_PATH = """
    WITH up AS (SELECT o_orderkey AS k, ['o' || o_orderkey, 'c' || c_custkey, 'n' || n_nationkey, 'r' || n_regionkey, 'root'] AS p,
        [1 + o_orderkey % 3, 1 + c_custkey % 4, 1 + n_nationkey % 2, CAST(1 AS BIGINT)] AS w
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
    ends AS (SELECT min(k) AS lo, max(k) AS hi FROM up),
    both_ends AS (SELECT x.p AS px, y.p AS py, x.w AS wx, y.w AS wy, list_min(list_filter(range(1, 6), lambda i: x.p[i] = y.p[i])) AS m
      FROM ends JOIN up x ON x.k = lo JOIN up y ON y.k = hi),
    way AS (SELECT list_concat(px[1:m], list_reverse(py[1:m - 1])) AS p, list_concat(wx[1:m - 1], list_reverse(wy[1:m - 1])) AS w FROM both_ends)
    SELECT i AS step, p[i] AS from_id, p[i + 1] AS to_id, CAST(w[i] AS DOUBLE) AS weight, CAST(list_sum(w[1:i]) AS DOUBLE) AS total_weight
    FROM (SELECT p, w, unnest(range(1, len(p))) AS i FROM way)"""


@check("j10_path_edges", _TREE_PATH)
def path_edges(spark, d):
    def edge(table, a, b, w):
        ends = [F.concat(F.lit(p), c.cast("string")) for p, c in (a, b)]
        return A.table(spark, d, table).select(ends[0].alias("source_id"), ends[1].alias("target_id"), F.lit("semantic").alias("edge_type"), w.cast("double").alias("weight"))

    c = F.col
    edges = edge("orders", ("o", c("o_orderkey")), ("c", c("o_custkey")), 1 + c("o_orderkey") % 3)
    edges = edges.unionByName(edge("customer", ("c", c("c_custkey")), ("n", c("c_nationkey")), 1 + c("c_custkey") % 4))
    edges = edges.unionByName(edge("nation", ("n", c("n_nationkey")), ("r", c("n_regionkey")), 1 + c("n_nationkey") % 2))
    edges = edges.unionByName(edge("region", ("r", c("r_regionkey")), ("root", F.lit("")), F.lit(1)))
    edges = materialize(edges, "tree")
    first, last = A.table(spark, d, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).head()
    return J.path_edges(edges, J.shortest_path(edges, f"o{first}", f"o{last}"))


@check("j10_shortest_path", with_views("links", f"""WITH
    walk(start, node, depth) AS (SELECT s, s, CAST(0 AS BIGINT) FROM (SELECT unnest(['img_0', 'tag_src8', 'img_1']) AS s) UNION
      SELECT w.start, l.neighbour, w.depth + 1 FROM walk w JOIN links l ON l.node = w.node WHERE w.depth < 6)
    {_path_sql('far', 'img_0', 'tag_src12')} UNION ALL {_path_sql('tags', 'tag_src8', 'tag_src12')} UNION ALL {_path_sql('self', 'img_1', 'img_1')}
    UNION ALL SELECT 'none', NULL""", recursive=True))
def shortest_path(spark, d):
    g = _graph(spark, d)
    routes = [("far", "img_0", "tag_src12"), ("tags", "tag_src8", "tag_src12"), ("self", "img_1", "img_1"), ("none", "img_0", "nowhere")]
    out = None
    for name, source, target in routes:
        row = J.path_length(g.edges, source, target).select(F.lit(name).alias("route"), "length")
        out = row if out is None else out.unionByName(row)
    return out


_STATS = """
    SELECT 'total' AS section, 'nodes' AS name, CAST(count(*) AS DOUBLE) AS value FROM nodes
    UNION ALL SELECT 'total', 'edges', count(*) FROM edges
    UNION ALL SELECT 'total', 'communities', (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT node FROM links)) + 1
    UNION ALL SELECT 'total', 'avg_degree', round((SELECT count(*) FROM (SELECT DISTINCT node, neighbour, edge_type FROM links)) / (SELECT count(*) FROM nodes), 6)
    UNION ALL SELECT 'total', 'density', round((SELECT count(*) FROM edges) / (SELECT count(*) * (count(*) - 1) / 2.0 FROM nodes), 6)
    UNION ALL SELECT 'total', 'diameter', NULL
    UNION ALL SELECT 'node_type', node_type, count(*) FROM nodes GROUP BY 2
    UNION ALL SELECT 'edge_type', edge_type, count(*) FROM edges GROUP BY 2"""


@check("j11_graph_stats", with_views("nodes, edges, links", _STATS))
def graph_stats(spark, d):
    g = _graph(spark, d)
    return J.graph_stats(g.nodes, g.edges, g.parts, g.simple).withColumn("value", F.round("value", 6))


@check("j12_scans", parts_sql("""
    SELECT id, 'community' AS part FROM parts WHERE component = (SELECT min(component) FROM parts)
    UNION ALL SELECT id, 'node' FROM nodes WHERE node_type = 'image'
    UNION ALL SELECT source_id || '-' || target_id || '-' || edge_type, 'edge' FROM sem_edges
    UNION ALL SELECT DISTINCT component, 'communities' FROM parts"""))
def scans(spark, d):
    nodes, edges = _semantic(spark, d)
    parts = J.components(nodes, edges)
    first = parts.agg(F.min("component")).scalar()
    rows = [
        (J.community_nodes(nodes, parts, first).select("id"), "community"),
        (nodes.select("id"), "node"),
        (edges.select("id"), "edge"),
        (parts.select(F.col("component").alias("id")).distinct(), "communities"),
    ]
    out = None
    for df, part in rows:
        df = df.withColumn("part", F.lit(part))
        out = df if out is None else out.unionByName(df)
    return out


@check("j13_search_nodes", with_views("nodes", """
    SELECT id, label FROM nodes WHERE contains(lower(label), 'src1') OR contains(lower(coalesce(description, '')), 'src1') OR contains(lower(coalesce(category, '')), 'src1')
    ORDER BY id LIMIT 20"""))
def search_nodes(spark, d):
    return J.search_nodes(_graph(spark, d).nodes, "SRC1").select("id", "label")


@check("j14_build_graph", with_views("nodes, edges, links", """
    SELECT n.id, n.node_type, count(DISTINCT l.neighbour || l.edge_type) AS degree, CAST(0 AS BIGINT) AS community_id
    FROM nodes n JOIN links l ON l.node = n.id GROUP BY 1, 2"""))
def build_graph(spark, d):
    return _graph(spark, d).node_table().select("id", "node_type", "degree", "community_id")


@check("j15_filter_edges", with_views("edges", "SELECT edge_type, count(*) AS n FROM edges WHERE edge_type IN ('semantic', 'tag_overlap') GROUP BY 1"))
def filter_edges(spark, d):
    return J.filter_edges(_graph(spark, d).edges).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))
