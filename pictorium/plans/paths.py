"""Two-sided, level-synchronous breadth-first search over an edge table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch


class Level(NamedTuple):
    """One grown level: its side, its depth there, and its number of nodes."""

    side: str
    depth: int
    nodes: int


class _Side:
    """The levels grown from one end; each is a stored table ``(node, rank, parent)``.  Ranks are in the order of the nodes of a level,
    and a parent is a rank of the level before."""

    def __init__(self, spark: SparkSession, name: str, start: str, scratch: Scratch):
        self.name, self.start, self.size = name, start, 1
        # written, so that Catalyst knows its size
        self.levels = [scratch.write(spark.createDataFrame([(start, 0, None)], "node string, rank long, parent long"))[0]]

    @property
    def depth(self) -> int:
        return len(self.levels) - 1

    def grow(self, edges: DataFrame, scratch: Scratch) -> None:
        """The next level.  Neighbours of a level lie in it, in the one before or in the next, so nothing older is looked at.  Of several
        parents the smallest is kept, by its rank: the minimum of a number is taken where the edges are read, that of a text needs them sorted."""
        if not self.depth:
            edges = edges.filter((F.col("a") == self.start) | (F.col("b") == self.start))
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        near = self.levels[-1].select("node")
        known = near if len(self.levels) == 1 else near.unionByName(self.levels[-2].select("node"))
        step = both.join(self.levels[-1].select(F.col("node").alias("a"), "rank"), "a").groupBy(F.col("b").alias("node")).agg(F.min("rank").alias("parent"))
        found = step.join(known, "node", "left_anti").orderBy("node")
        fresh, seen = scratch.write(found.select("node", F.monotonically_increasing_id().alias("rank"), "parent"), n=F.count(F.lit(1)))
        self.levels.append(fresh)
        self.size = seen["n"]

    def way(self, node: str) -> list[str]:
        """From a node of the last level back to the start."""
        at = self.levels[-1].filter(F.col("node") == node).head()
        path = [node]
        for level in reversed(self.levels[:-1]):
            at = level.filter(F.col("rank") == at["parent"]).head()
            path.append(at["node"])
        return path


def shortest_path(
    edges: DataFrame, source: str, target: str, max_depth: int | None = None, src: str = "src", dst: str = "dst", trace: list[Level] | None = None
) -> DataFrame:
    """``(step, node)`` from source (step 0) to target over undirected edges;
    no rows when unreachable (within ``max_depth`` steps, if one is given).

    Both ends grow towards each other, each time the one whose last level has fewer nodes.  While the two balls are apart, the first node
    they share lies in the last level of both, so a level is joined with the edges, with the level before it and with the other end's last
    level, and with nothing older.  Of several meeting nodes the smallest is taken.  Only the path itself passes through the driver.

    The edges are read once a level, as they are stored: both directions are made of a row that is read, and a level that is small enough to be
    broadcast finds its edges there, so edges are neither written again nor moved.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "path")
    schema = "step long, node string"
    if source == target:
        known = edges.filter((F.col(src) == source) | (F.col(dst) == source)).limit(1)
        return known.select(F.lit(0).cast("long").alias("step"), F.lit(source).alias("node"))
    ends = (_Side(spark, "source", source, scratch), _Side(spark, "target", target, scratch))
    while max_depth is None or ends[0].depth + ends[1].depth < max_depth:
        side = min(ends, key=lambda e: e.size)
        other = ends[1] if side is ends[0] else ends[0]
        side.grow(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")), scratch)
        if trace is not None:
            trace.append(Level(side.name, side.depth, side.size))
        if not side.size:
            return spark.createDataFrame([], schema)
        met = side.levels[-1].join(other.levels[-1].select("node"), "node", "left_semi").agg(F.min("node")).head()[0]
        if met is not None:
            path = ends[0].way(met)[::-1] + ends[1].way(met)[1:]
            return spark.createDataFrame(list(enumerate(path)), schema)
    return spark.createDataFrame([], schema)
