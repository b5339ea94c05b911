"""Similarity/tag graph: nodes, edges, components, neighbours, paths.

Nodes are rows ``(id, node_type, label, tags, description, category,
tag_count)``, edges ``(id, source_id, target_id, edge_type, weight)``.  Edges
are undirected for every traversal.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pictorium.functions import fixed_values as V
from pictorium.functions.text import base_name, contains_ci
from pictorium.functions.vectors import norm
from pictorium.plans.components import connected_components, update_components
from pictorium.plans.ordering import number_all
from pictorium.plans.paths import shortest_path as _shortest_path
from pictorium.plans.scratch import Scratch, materialize
from pictorium.plans.skew import HOT_ROWS, lookup_join
from pictorium.plans.vector_join import cosine_pairs

EDGE_TYPES = V.EDGE_TYPES


def edge_type(name: Column) -> Column:
    """Unknown names become ``custom``."""
    return F.when(name.isin(EDGE_TYPES), name).otherwise(F.lit("custom"))


def image_node_id(asset_id: Column) -> Column:
    return F.concat(F.lit("img_"), asset_id.cast("string"))


def tag_node_id(tag: Column) -> Column:
    return F.concat(F.lit("tag_"), tag)


def image_nodes(assets: DataFrame) -> DataFrame:
    shown = assets.filter(F.col("ai_status").isin("verified", "provisional", "completed"))
    return shown.select(
        image_node_id(F.col("id")).alias("id"),
        F.lit("image").alias("node_type"),
        base_name(F.col("file_path")).alias("label"),
        F.coalesce("ai_tags", F.array().cast("array<string>")).alias("tags"),
        F.col("ai_description").alias("description"),
        F.col("ai_category").alias("category"),
        F.lit(None).cast("long").alias("tag_count"),
    )


def tag_nodes(images: DataFrame, min_count: int = 2) -> DataFrame:
    """Tags that occur at least twice."""
    counts = images.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= min_count).select(
        tag_node_id(F.col("tag")).alias("id"),
        F.lit("tag").alias("node_type"),
        F.col("tag").alias("label"),
        F.array().cast("array<string>").alias("tags"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("category"),
        F.col("n").alias("tag_count"),
    )


def _edge(source: Column, target: Column, kind: str, weight: Column) -> list[Column]:
    return [
        F.concat_ws("-", source, target, F.lit(kind)).alias("id"),
        source.alias("source_id"),
        target.alias("target_id"),
        F.lit(kind).alias("edge_type"),
        weight.alias("weight"),
    ]


class SemanticPairs(NamedTuple):
    """All similar pairs, factorised: ``pairs(a, b, similarity)`` between the first of each group of
    equal vectors, and ``members(id, first, copies)`` of all groups."""

    pairs: DataFrame
    members: DataFrame


def semantic_pairs(vectors: DataFrame, threshold: float = V.SEMANTIC_FROM, known: DataFrame | None = None, **options) -> SemanticPairs:
    """Pairs of vectors ``(id, embedding)`` with cosine >= threshold.  Copies
    of one vector are never written out pair by pair; see :func:`expand_pairs`
    and :func:`pair_degrees` for what every copy is linked to.  Empty and all-zero vectors are similar to nothing.
    With ``known`` (column ``id``, image nodes) the pairs are those of its vectors."""
    usable = vectors.filter((F.size("embedding") > 0) & (norm(F.col("embedding")) > 0)).select("id", "embedding")
    first = usable.groupBy("embedding").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    scratch = Scratch(vectors.sparkSession, "distinct")
    first, seen = scratch.write(first, total=F.sum("copies"))
    asked = first.select(F.col("first").alias("id"), "embedding")
    if known is not None:
        asked = asked.join(known.select(F.col("id").alias("node")), image_node_id(F.col("id")) == F.col("node"), "left_semi")
    pairs = cosine_pairs(asked, threshold, **options)
    members = lookup_join(usable, first, ["embedding"], seen["total"] or 0, HOT_ROWS, first.select("embedding", F.col("copies").alias("n")))
    return SemanticPairs(pairs, scratch.write(members.select("id", "first", "copies"))[0])


def _similar_groups(found: SemanticPairs) -> DataFrame:
    """``(first, other, similarity)`` in both directions, and a group with itself if it has copies."""
    there = found.pairs.select(F.col("a").alias("first"), F.col("b").alias("other"), "similarity")
    back = found.pairs.select(F.col("b").alias("first"), F.col("a").alias("other"), "similarity")
    own = found.members.filter("id = first and copies > 1").select("first", F.col("first").alias("other"), F.lit(1.0).alias("similarity"))
    return there.unionByName(back).unionByName(own)


def expand_pairs(found: SemanticPairs, asked: DataFrame | None = None) -> DataFrame:
    """``(id, neighbour, similarity)`` of the asked vectors (column ``id``), or of all: every
    copy with every copy of every similar vector.  Its size is that of the answer, so ask for some when groups are large."""
    mine = found.members if asked is None else found.members.join(asked.select("id").distinct(), "id", "left_semi")
    others = found.members.select(F.col("id").alias("neighbour"), F.col("first").alias("other"))
    near = mine.select("id", "first").join(_similar_groups(found), "first").join(others, "other")
    return near.filter("id != neighbour").select("id", "neighbour", "similarity")


def pair_degrees(found: SemanticPairs) -> DataFrame:
    """``(id, degree)`` from the group sizes, without writing out pairs."""
    sizes = found.members.filter("id = first").select(F.col("first").alias("other"), "copies")
    total = _similar_groups(found).join(sizes, "other").groupBy("first").agg(F.sum("copies").alias("total"))
    degree = F.coalesce("total", F.lit(0)) - F.when(F.col("copies") > 1, 1).otherwise(0)
    return found.members.join(total, "first", "left").select("id", degree.cast("long").alias("degree"))


def star_pairs(vectors: DataFrame, threshold: float = V.SEMANTIC_FROM, known: DataFrame | None = None, **options) -> DataFrame:
    """``(a, b, similarity)``, ``a <= b``: the pairs between the first of each group of equal vectors, and one of each copy with its first.
    They have the components of :func:`linked_pairs` in linear size, and are not all pairs."""
    found = semantic_pairs(vectors, threshold, known, **options)
    pairs = found.pairs
    if threshold <= 1:
        copies = found.members.filter("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
        for end in ("a", "b") if known is not None else ():
            copies = copies.join(known.select(F.col("id").alias("node")), image_node_id(F.col(end)) == F.col("node"), "left_semi")
        pairs = pairs.unionByName(copies)
    return pairs


def linked_pairs(vectors: DataFrame, threshold: float = V.SEMANTIC_FROM, known: DataFrame | None = None, **options) -> DataFrame:
    """``(a, b, similarity)``, ``a <= b``: all pairs with cosine >= threshold, those of copies of a vector as well, given out where they
    are found and not moved.  A row that comes again counts once.  Numbers are several times smaller than the texts of an edge."""
    rows = vectors.select("id", "embedding")
    if known is not None:
        rows = rows.join(known.select(F.col("id").alias("node")), image_node_id(F.col("id")) == F.col("node"), "left_semi")
    return cosine_pairs(rows.dropDuplicates(["id", "embedding"]), threshold, **options)


def single_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """:func:`linked_pairs`, each pair of ids once.  Two vectors meet once, so pairs can only repeat where an id has several vectors;
    ids are counted, which are few, and pairs, which grow with the square of them, are moved in that case only."""
    ids = vectors.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("n > 1").isEmpty():
        return pairs
    return pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def pair_edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(*_edge(image_node_id(F.col("a")), image_node_id(F.col("b")), "semantic", F.col("similarity")))


def semantic_edges(vectors: DataFrame, threshold: float = V.SEMANTIC_FROM, known: DataFrame | None = None, stars: bool = True, **options) -> DataFrame:
    """Edges of similar vectors; ids become image nodes.  With ``known`` only edges between those nodes: vectors
    are filtered before they meet, as pairs are many more.

    With ``stars`` each copy of a vector has one edge of weight 1 to the first of them, whose edges stand for all: the
    same components, in linear size, for walks that need no more.  Without, these are the edges of all pairs, as a graph stores them."""
    return pair_edges((star_pairs if stars else linked_pairs)(vectors, threshold, known, **options))


def tag_edges(images: DataFrame, tags: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Image to each of its tag nodes, once.  A tag's count says beforehand
    whether it is a hot key of the join."""
    held = images.select(F.col("id").alias("image"), F.explode(F.array_distinct("tags")).alias("label"))
    total = tags.agg(F.sum("tag_count")).head()[0] or 0
    joined = lookup_join(held, tags.select("label"), ["label"], total, hot_rows, tags.select("label", F.col("tag_count").alias("n")))
    return joined.select(*_edge(F.col("image"), tag_node_id(F.col("label")), "tag_overlap", F.lit(1.0)))


def dedup_edges(edges: DataFrame, order: str | None = None) -> DataFrame:
    """Unique by (source, target, type); the first by ``order`` wins."""
    keys = ["source_id", "target_id", "edge_type"]
    first = Window.partitionBy(*keys).orderBy(order or "id")
    return edges.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") == 1).drop("_rank")


def filter_edges(edges: DataFrame, types: tuple[str, ...] = ("semantic", "tag_overlap")) -> DataFrame:
    return edges.filter(F.col("edge_type").isin(list(types)))


def both_ways(edges: DataFrame) -> DataFrame:
    """``(node, neighbour, edge_type, weight)`` in both directions."""
    there = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("neighbour"), "edge_type", "weight")
    back = edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("neighbour"), "edge_type", "weight")
    return there.unionByName(back)


def degrees(nodes: DataFrame, edges: DataFrame, simple: bool = False) -> DataFrame:
    """``(id, degree)``: distinct (neighbour, type) pairs, 0 without edges.  ``simple`` says that no two edges of a type have the same
    ends, in either direction, as those of :func:`build_graph`: then ends are counted where the edges are read, and no edge is moved."""
    # an edge is moved once for both of its ends
    ends = F.least("source_id", "target_id").alias("low"), F.greatest("source_id", "target_id").alias("high")
    open_end = (F.col("source_id").isNull() | F.col("target_id").isNull()).alias("open")  # no loop, though least and greatest are the same
    pairs = edges.select(*ends, "edge_type", open_end)
    if not simple:
        pairs = pairs.distinct()
    counts = pairs.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def components(nodes: DataFrame, edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(id, component)``: the component is named by its smallest node id."""
    parts = connected_components(edges, nodes.select(F.col("id").alias("node")), "source_id", "target_id", hot_rows, others=True)
    return parts.select(F.col("node").alias("id"), "component")


def components_after(parts: DataFrame, nodes: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """:func:`components` of the changed graph from the ``parts`` before the change; ``nodes`` and ``edges`` are those after it."""
    known = parts.select(F.col("id").alias("node"), "component")
    found = update_components(known, edges, added, removed, "source_id", "target_id", hot_rows).toDF("id", "component")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def number_components(parts: DataFrame) -> DataFrame:
    """``(id, community_id)``: components numbered 0, 1, … by smallest node."""
    roots = number_all(parts.select("component").distinct(), ["component"], "community_id", "roots")
    return parts.join(roots, "component").select("id", "community_id")


def component_stats(nodes: DataFrame, edges: DataFrame, parts: DataFrame, by: str = "component", simple: bool = False) -> DataFrame:
    """Per component: size, density, most connected node (NULL when nothing is
    connected).  ``simple`` as in :func:`degrees`."""
    degree = degrees(nodes, edges, simple)
    placed = parts.join(degree, "id")
    best = F.min(F.when(F.col("degree") > 0, F.struct((-F.col("degree")).alias("neg"), F.col("id").alias("id"))))
    sizes = placed.groupBy(by).agg(F.count(F.lit(1)).alias("size"), best.alias("best"))
    leaving = edges.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))  # added up where the edges are read
    inner = leaving.join(parts.select(F.col("id").alias("source_id"), by), "source_id").groupBy(by).agg(F.sum("n").alias("n_edges"))
    n = F.col("size").cast("double")
    density = F.when(F.col("size") > 1, F.coalesce("n_edges", F.lit(0)) / (n * (n - 1) / 2)).otherwise(F.lit(0.0))
    return sizes.join(inner, by, "left").select(by, "size", F.col("best.id").alias("central_node_id"), density.alias("density"))


def component_tags(nodes: DataFrame, parts: DataFrame, by: str = "component") -> DataFrame:
    """``(component, tag)``, distinct: the tags of its images and tag nodes."""
    own = F.when(F.col("node_type") == "tag", F.array("label")).otherwise(F.col("tags"))
    return nodes.select("id", F.explode(own).alias("tag")).join(parts, "id").select(by, "tag").distinct()


def neighbours(nodes: DataFrame, edges: DataFrame, node_id: str, types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Direct neighbours with their edge, heaviest first.  Unknown type names
    count as custom."""
    near = both_ways(edges.filter((F.col("source_id") == node_id) | (F.col("target_id") == node_id))).filter(F.col("node") == node_id)
    return _described(nodes, near, types, limit)


def _described(nodes: DataFrame, near: DataFrame, types: list[str] | None, limit: int | None) -> DataFrame:
    if types is not None:
        near = near.filter(F.col("edge_type").isin([t if t in EDGE_TYPES else "custom" for t in types]))
    found = near.join(nodes.select(F.col("id").alias("neighbour"), "node_type", "label"), "neighbour")
    found = found.select(F.col("neighbour").alias("id"), "node_type", "label", "edge_type", "weight", F.lit(1).cast("long").alias("distance"))
    ordered = found.orderBy(F.desc("weight"), "id", "edge_type")
    return ordered if limit is None else ordered.limit(limit)


def write_adjacency(edges: DataFrame, path: str) -> None:
    """Stores the edges in both directions, sorted by node and falling weight, in small row groups: a node's edges are one run
    (dictionary and run-length coded), a hub's run goes over several files, and a lookup by node skips all other files, row groups and pages."""
    rows, _ = Scratch(edges.sparkSession, "adjacency").write(both_ways(edges).select("node", (-F.col("weight")).alias("falling"), "neighbour", "edge_type"))
    order = ["node", "falling", "neighbour", "edge_type"]
    spark = edges.sparkSession  # a given number is not coalesced; each core has a file to write at least
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.size", str(4 << 20)).parquet(path)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """``(node, neighbour, edge_type, weight)`` as stored."""
    return spark.read.parquet(path).select("node", "neighbour", "edge_type", (-F.col("falling")).alias("weight"))


def stored_neighbours(nodes: DataFrame, adjacency: DataFrame, node_id: str, types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """:func:`neighbours` from a stored adjacency: the node reaches its scan."""
    return _described(nodes, adjacency.filter(F.col("node") == node_id), types, limit)


def neighbours_many(asked: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Batch form: ``asked(node)``, each node once, to the k heaviest
    neighbours of each.  Both sides of the join are plain shuffles, so AQE
    splits a node with very many edges, and the rank ships k rows per task."""
    order = Window.partitionBy("node").orderBy(F.desc("weight"), "neighbour", "edge_type")
    near = both_ways(edges).join(asked.select("node"), "node")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int | None = None) -> DataFrame:
    return _shortest_path(edges, source, target, max_depth, "source_id", "target_id")


def path_length(edges: DataFrame, source: str, target: str, max_depth: int | None = None) -> DataFrame:
    """One row with the hop count; NULL when unreachable."""
    return shortest_path(edges, source, target, max_depth).agg(F.max("step").alias("length"))


def path_edges(edges: DataFrame, path: DataFrame) -> DataFrame:
    """The heaviest edge of every hop of a path, with the running weight."""
    hops = path.select(F.col("step"), F.col("node").alias("to_id"), F.lag("node").over(Window.orderBy("step")).alias("from_id")).filter("step > 0")
    links = both_ways(edges).select(F.col("node").alias("from_id"), F.col("neighbour").alias("to_id"), "weight")
    best = links.join(hops, ["from_id", "to_id"]).groupBy("step", "from_id", "to_id").agg(F.max("weight").alias("weight"))
    # a path has a row per step
    return best.withColumn("total_weight", F.sum("weight").over(Window.orderBy("step")))


def graph_stats(nodes: DataFrame, edges: DataFrame, parts: DataFrame, simple: bool = False) -> DataFrame:
    """``(section, name, value)``; diameter is never computed (NULL).  ``simple`` as in :func:`degrees`."""
    n_nodes = nodes.agg(F.count(F.lit(1)).alias("n"))
    n_edges = edges.agg(F.count(F.lit(1)).alias("n"))
    degree = degrees(nodes, edges, simple).agg(F.sum("degree").alias("d"))
    n, e, d = n_nodes.scalar(), n_edges.scalar(), degree.scalar()
    n_parts = parts.select("component").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    value = n.cast("double")
    average = F.when(n > 0, d / F.when(n > 0, n)).otherwise(0.0)
    density = F.when(n > 1, e / F.when(n > 1, value * (value - 1) / 2)).otherwise(0.0)
    one = nodes.sparkSession.range(1)
    rows = F.array(
        *[
            F.struct(F.lit("total").alias("section"), F.lit(name).alias("name"), v.cast("double").alias("value"))
            for name, v in (
                ("nodes", n),
                ("edges", e),
                ("communities", n_parts),
                ("avg_degree", average),
                ("density", density),
                ("diameter", F.lit(None)),
            )
        ]
    )
    totals = one.select(F.inline(rows))

    def by_type(df, column, section):
        counted = df.groupBy(column).agg(F.count(F.lit(1)).cast("double").alias("value"))
        return counted.select(F.lit(section).alias("section"), F.col(column).alias("name"), "value")

    return totals.unionByName(by_type(nodes, "node_type", "node_type")).unionByName(by_type(edges, "edge_type", "edge_type"))


def community_nodes(nodes: DataFrame, parts: DataFrame, component, by: str = "component") -> DataFrame:
    return nodes.join(parts.filter(F.col(by) == component).select("id"), "id", "left_semi")


def search_nodes(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Case-insensitive substring of label, description or category."""
    hit = None
    for column in ("label", "description", "category"):
        part = F.coalesce(contains_ci(F.col(column), query), F.lit(False))
        hit = part if hit is None else hit | part
    return nodes.filter(hit).orderBy("id").limit(limit)


class Graph:
    """The tables of one build: nodes, edges and, once asked for, parts
    (components).  ``simple`` as in :func:`degrees`."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, parts: DataFrame | None = None, simple: bool = False):
        self.nodes, self.edges, self._parts, self._numbers, self.simple = nodes, edges, parts, None, simple

    @property
    def parts(self) -> DataFrame:
        if self._parts is None:
            self._parts = materialize(components(self.nodes, self.edges), "parts")
        return self._parts

    @property
    def numbers(self) -> DataFrame:
        """The parts with dense numbers, worked out once."""
        if self._numbers is None:
            self._numbers = materialize(number_components(self.parts), "numbers")
        return self._numbers

    def node_table(self) -> DataFrame:
        """Stored form of the nodes (properties as JSON)."""
        keyed = self.nodes.join(degrees(self.nodes, self.edges, self.simple), "id").join(self.numbers, "id")
        image = F.to_json(F.struct("description", "category", "tags"))
        tag = F.to_json(F.struct(F.col("tag_count").alias("count"), F.lit("auto").alias("tag_type")))
        return keyed.select(
            "id", "node_type", "label", F.when(F.col("node_type") == "tag", tag).otherwise(image).alias("properties"), "community_id", "degree"
        )

    def edge_table(self) -> DataFrame:
        return self.edges.withColumn("properties", F.lit("{}"))

    def community_table(self) -> DataFrame:
        return component_stats(self.nodes, self.edges, self.numbers, "community_id", self.simple).withColumnRenamed("community_id", "id")

    def community_tag_table(self) -> DataFrame:
        return component_tags(self.nodes, self.numbers, "community_id")


def build_graph(assets: DataFrame, vectors: DataFrame | None = None, threshold: float = V.SEMANTIC_FROM) -> Graph:
    """Image nodes, tag nodes, semantic and tag edges; components follow on
    first use.  Nodes and edges are written once, as everything downstream reads them repeatedly.  Semantic edges, which grow with
    the square of the vectors, are written as pairs of ids where they are found; texts are made when they are read."""
    scratch = Scratch(assets.sparkSession, "graph")
    images = image_nodes(assets)
    tags = tag_nodes(images)
    nodes, _ = scratch.write(images.unionByName(tags))
    edges, _ = scratch.write(dedup_edges(tag_edges(nodes.filter("node_type = 'image'"), nodes.filter("node_type = 'tag'"))))
    if vectors is not None:
        pairs, _ = scratch.write(single_pairs(linked_pairs(vectors, threshold, nodes.select("id")), vectors))
        edges = pair_edges(pairs).unionByName(edges)
    return Graph(nodes, edges, simple=True)
