"""Connected components by alternating large-star and small-star rounds.

Published as "Connected Components in MapReduce and Beyond" (Kiveris et al.,
SoCC 2014).  Before the first round every task that reads edges keeps a star per component of its own
edges, at most an edge per node, so edges that are many times the nodes are not moved.  Each round is one map-side-combined minimum per node and one join;
the number of rounds grows with the logarithm of the component size, not with
its diameter.  A node that holds a third of all edges is looked up by broadcast
(see :mod:`pictorium.plans.skew`), so its edges never meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import HOT_ROWS, lookup_join, shuffled

# edges that a task holds before it makes stars of them; stars that it holds before it gives them out
CHUNK_EDGES, MOST_STARS = 1 << 20, 1 << 20
# bits that a broadcast set of keys has at most (8 MB)
MAX_SLOTS = 1 << 26


def _stars(edges: DataFrame, centres: bool = False) -> DataFrame:
    """Edges ``(u, v)`` of the same components, ``u > v``: per task those from each node to the smallest that it reaches there, and with
    ``centres`` one from this to itself."""

    def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """The smallest number that each of ``0 … n - 1`` reaches over the edges ``a``-``b``."""
        root = np.arange(n)
        while True:
            x, y = root[a], root[b]
            open_edges = x != y
            if not open_edges.any():
                return root
            a, b, x, y = a[open_edges], b[open_edges], x[open_edges], y[open_edges]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # the smallest, so that a hub takes two rounds
            while not np.array_equal(up := root[root], root):
                root = up

    def contract(tables: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(tables)
        both = pa.chunked_array(table.column("u").chunks + table.column("v").chunks).combine_chunks().dictionary_encode()
        rank = np.empty(len(both.dictionary), np.int64)
        order = pc.sort_indices(both.dictionary)
        rank[order.to_numpy()] = np.arange(len(rank))
        codes = rank[both.indices.to_numpy()]
        root = roots(codes[: table.num_rows], codes[table.num_rows :], len(rank))
        names, u = both.dictionary.take(order), np.flatnonzero(root != np.arange(len(rank)))
        if centres:
            u = np.append(u, np.unique(root[u]))
        return pa.table({"u": names.take(pa.array(u)), "v": names.take(pa.array(root[u]))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, stars = [], 0, 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows - stars >= CHUNK_EDGES:
                held = [contract(held)]
                rows = stars = held[0].num_rows
                if stars >= MOST_STARS:
                    yield from held[0].to_batches()
                    held, rows, stars = [], 0, 0
        if rows:
            yield from contract(held).to_batches()

    return edges.mapInArrow(run, edges.schema)


def _without_leaves(stars: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of :func:`_stars` with centres, without centres and without leaves that are not among ``nodes``, each once.  A leaf has a single
    edge, to a smaller node, so it neither joins nor names a component, and rounds need not move it.  Edges are moved once, by ``u``."""
    ends = stars.repartition("u").groupBy("u").agg(F.collect_set("v").alias("vs"))  # a task has a few edges of a node at most
    asked = nodes.select(F.col("node").alias("u"), F.lit(True).alias("asked")).distinct()
    inner = F.col("asked").isNotNull() | (F.size("vs") > 1) | F.array_contains("vs", F.col("u"))
    kept = ends.join(asked.hint("shuffle_hash"), "u", "left").filter(inner)
    return kept.select("u", F.explode("vs").alias("v")).filter(F.col("u") != F.col("v"))


def _maybe_among(rows: DataFrame, columns: list[str], keys: DataFrame, n: int) -> DataFrame:
    """The ``columns`` of the rows that have all of them among ``n`` keys (column ``node``), and of few others: one bit per hash of a key
    travels to the tasks, so a join with the keys need not move rows that it would drop."""
    slots = min(MAX_SLOTS, 1 << max(10, (16 * n).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots).cast("long"))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    held = keys.select(slot("node").alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(slots >> 6, np.uint64)
    words[held.column("at").to_numpy()] = held.column("bits").to_numpy().view(np.uint64)
    shipped = rows.sparkSession.sparkContext.broadcast(words)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shipped.value
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            for c in columns:
                s = batch.column(f"slot_{c}").to_numpy(zero_copy_only=False)
                good &= (words[s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            yield batch.filter(pa.array(good)).select(columns)

    plain = rows.select(*columns)
    return plain.select("*", *[slot(c).alias(f"slot_{c}") for c in columns]).mapInArrow(keep, plain.schema)


def _large_star(edges: DataFrame, total: int, hot_rows: int, scratch: Scratch) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = _with_lowest(both, 2 * total, hot_rows, scratch)
    root = F.least("low", "u")
    return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), root.alias("v"))


def _small_star(edges: DataFrame, total: int, hot_rows: int, scratch: Scratch) -> DataFrame:
    # edges point from the larger to the smaller end here
    joined = _with_lowest(edges, total, hot_rows, scratch)
    moved = joined.filter(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    own = joined.select("u", F.col("low").alias("v"))
    return moved.unionByName(own).distinct()


def _with_lowest(edges: DataFrame, total: int, hot_rows: int, scratch: Scratch) -> DataFrame:
    """Edges with the smallest neighbour of ``u`` (column ``low``)."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n"))
    if total > hot_rows:
        lowest, _ = scratch.write(lowest)
    return lookup_join(edges, shuffled(lowest.select("u", "low")), ["u"], total, hot_rows, lowest.select("u", "n"))


def connected_components(
    edges: DataFrame, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst", hot_rows: int = HOT_ROWS, others: bool = False
) -> DataFrame:
    """``(node, component)`` where component is the smallest node reached.

    Without ``nodes`` only nodes with an edge appear; with it (column
    ``node``) isolated nodes form their own component.  ``others`` says that edges may have many ends that are not among ``nodes``.
    """
    scratch = Scratch(edges.sparkSession, "components")
    a, b = F.col(src), F.col(dst)
    start = edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    fingerprint = {
        "n": F.count(F.lit(1)),
        "x": F.bit_xor(F.xxhash64("u", "v")),
    }
    stars = _stars(start).distinct() if nodes is None or not others else _without_leaves(_stars(start, centres=True), nodes)
    current, seen = scratch.write(stars, **fingerprint)
    while seen["n"]:
        large = _large_star(current, seen["n"], hot_rows, scratch).distinct()
        staged = seen["n"] > hot_rows
        if staged:  # one job per round while the graph is small
            large, _ = scratch.write(large)
        table, after = scratch.write(_small_star(large, seen["n"], hot_rows, scratch), **fingerprint)
        if staged:
            scratch.drop(large)
        scratch.drop(current)
        current = table
        if (after["n"], after["x"]) == (seen["n"], seen["x"]):
            break
        seen = after
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if nodes is not None:
        joined = nodes.select("node").distinct().join(shuffled(members), "node", "left")
        return joined.select("node", F.coalesce("component", "node").alias("component"))
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return members.unionByName(roots)


def update_components(
    labels: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame, src: str = "src", dst: str = "dst", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``(node, component)`` after a change of the edges, from the stored ``labels`` before it.

    ``edges`` are all edges after the change, ``added`` and ``removed`` the difference.  Only components that lost an edge are
    walked anew, over their own edges, or all of them if they hold most nodes.  Added edges are then drawn between labels: the components of
    that graph say which labels become one.  Everything else keeps its stored label, so the work follows the change: one scan of the
    edges (to find those of the walked components) and one of the labels.  Nodes of added edges that have no label yet are new."""
    scratch = Scratch(labels.sparkSession, "components")
    total = labels.count()
    ends = removed.select(F.col(src).alias("node")).unionByName(removed.select(F.col(dst).alias("node")))
    ends = _maybe_among(ends, ["node"], labels, total).distinct()
    lost, seen = scratch.write(labels.join(ends, "node", "left_semi").select("component").distinct(), n=F.count(F.lit(1)))
    if seen["n"]:
        walked, found = scratch.write(labels.join(lost, "component", "left_semi").select("node"), n=F.count(F.lit(1)))
        if 2 * found["n"] < total:
            inside = _maybe_among(edges, [src, dst], walked, found["n"])
            inside = inside.join(walked.withColumnRenamed("node", src), src, "left_semi").join(walked.withColumnRenamed("node", dst), dst, "left_semi")
            again = connected_components(inside, walked, src, dst, hot_rows)
            again = labels.join(lost, "component", "left_anti").select("node", "component").unionByName(again)
        else:  # most nodes: then all are walked, where the edges lie
            again = connected_components(edges, labels.select("node"), src, dst, hot_rows, others=True)
        labels, _ = scratch.write(again)
    new = added.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    touched = new.select(F.col("a").alias("node")).unionByName(new.select(F.col("b").alias("node"))).distinct()
    known, _ = scratch.write(touched.join(labels.select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    # an edge between nodes and those from the nodes to their labels join what an edge between the labels would, and are not moved
    drawn = new.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(known.select(F.col("node").alias("x"), F.col("component").alias("y")))
    names = known.select(F.col("component").alias("node")).distinct()
    merged, _ = scratch.write(connected_components(drawn, names, "x", "y", hot_rows, others=True).toDF("component", "label"))
    fresh = known.join(labels.select("node"), "node", "left_anti")
    rows = labels.select("node", "component").unionByName(fresh)
    # merged has one row per label that an added edge touches
    return rows.join(merged, "component", "left").select("node", F.coalesce("label", "component").alias("component"))
