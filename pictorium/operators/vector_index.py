"""A stored cluster index of vectors, searched exactly and best first.

*Storage.*  Unit vectors of one length lie in the cell of their nearest pivot and there in a *shell* by their angle to it; ``part`` names both.
``vectors`` holds (id, v, part) sorted by part and angle, so a search opens the row groups of its parts only; a cell of very many vectors,
copies too, is dealt to several files by ranges.  ``parts`` holds count, least and largest angle of each part and append.
Pivots are spherical k-means centres of a bounded sample (``SAMPLE`` vectors): they decide how much is read, never what is found.
*Growth.*  ``append_vectors`` places new vectors by the stored pivots and adds files.
*Search.*  Angles on the sphere obey the triangle inequality: a vector at angle ``a`` of its pivot, which is at angle ``b`` of the query, is
at least ``|a - b|`` from the query.  So every part has an upper bound of its cosines.  Each query reads its best parts in waves that grow fourfold, and
ends when its k-th result beats the bounds of all unread parts.  The driver holds a matrix of queries x parts of at most ``MAX_BOUNDS`` numbers;
beyond it, or beyond the broadcast size of the queries, the block join of ``cosine_topk`` gives the same rows.

Only cosines above 0 are found, so vectors of other lengths, empty and all-zero ones never are.  Query ids are unique.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pictorium.plans.scratch import Scratch
from pictorium.plans.vector_join import MAX_BROADCAST_NUMBERS, TILE, cosine_topk, unit_vectors

SAMPLE = 20_000
MAX_PIVOTS = 2048
SHELLS = 32
MAX_BOUNDS = 16_000_000
#: Parts that are pushed to the scan one by one.
MAX_PUSHED = 1_000
#: Cosines that a task remembers of all queries together (32 MB).
MAX_TOP = 4_000_000
ROW_GROUP_BYTES = 8 << 20
#: Slack of rounded cosines and angles.
SLACK = 1e-7


def _centres(sample: np.ndarray, pivots: int, rounds: int = 4) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    rng = np.random.default_rng(7)
    centres = sample[rng.permutation(len(sample))[:pivots]]
    for _ in range(rounds):
        home = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        length = np.linalg.norm(sums, axis=1)
        centres = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], centres)
    return centres


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def write_vector_index(vectors: DataFrame, path: str, dimension: int, id_col: str = "id", vec_col: str = "embedding", pivots: int | None = None) -> None:
    """A new index of the vectors of length ``dimension``."""
    spark = vectors.sparkSession
    units = unit_vectors(vectors.filter(F.size(vec_col) == dimension), id_col, vec_col)
    n = units.count()
    share = min(1.0, 1.2 * SAMPLE / max(n, 1))
    rows = units.select("v").sample(share, 7).limit(SAMPLE).collect() if share < 1 else units.select("v").limit(SAMPLE).collect()
    sample = np.array([r["v"] for r in rows]).reshape(len(rows), dimension)
    count = max(1, min(pivots or math.isqrt(n), MAX_PIVOTS, len(sample)))
    centres = _centres(sample, count) if len(sample) else np.eye(1, dimension)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
    _add(units, path, "overwrite")


def append_vectors(vectors: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding") -> None:
    """Adds vectors; those of another length than the index are left out."""
    dimension = len(vectors.sparkSession.read.parquet(f"{path}/pivots").head()["v"])
    _add(unit_vectors(vectors.filter(F.size(vec_col) == dimension), id_col, vec_col), path, "append")


def _pivots(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["v"] for r in spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()])


def _add(units: DataFrame, path: str, mode: str) -> None:
    spark = units.sparkSession
    shipped = spark.sparkContext.broadcast(_pivots(spark, path))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows == 0:
                continue
            v = _matrix(batch.column("v"))
            home, best = [], []
            for at in range(0, len(v), TILE):
                sims = v[at : at + TILE] @ shipped.value.T
                home.append(sims.argmax(1))
                best.append(sims.max(1))
            angle = np.arccos(np.clip(np.concatenate(best), -1, 1))
            shell = np.minimum((angle * (SHELLS / math.pi)).astype(int), SHELLS - 1)
            part = (np.concatenate(home) * SHELLS + shell).astype("int32")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(part), pa.array(angle)], names=["id", "v", "part", "angle"])

    id_type = units.schema["id"].dataType.simpleString()
    scratch = Scratch(spark, "vectors")
    placed, _ = scratch.write(units.mapInArrow(place, f"id {id_type}, v array<double>, part int, angle double"))
    dealt = placed.repartitionByRange("part", "angle", "id").sortWithinPartitions("part", "angle", "id")
    dealt.write.mode(mode).option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(f"{path}/vectors")
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"))
    parts.coalesce(1).write.mode(mode).parquet(f"{path}/parts")
    scratch.close()


@dataclass
class Wave:
    """What one wave has read: parts, vectors in them, and (query, part) meetings out of all."""

    parts: int
    vectors: int
    meetings: int
    possible: int


def search_index(
    queries: DataFrame,
    path: str,
    k: int,
    min_similarity: float = 0.0,
    query_id: str = "query_id",
    vec_col: str = "embedding",
    first: int = 4,
    max_numbers: int = MAX_BROADCAST_NUMBERS,
    max_bounds: int = MAX_BOUNDS,
) -> tuple[DataFrame, list[Wave]]:
    """``(query_id, id, similarity, rank)`` as ``cosine_topk`` gives them for cosines above 0, and what was read."""
    spark = queries.sparkSession
    scratch = Scratch(spark, "vector-search")
    least = max(min_similarity, 1e-12)
    stored = spark.read.parquet(f"{path}/vectors")
    pivots = _pivots(spark, path)
    asked, seen = scratch.write(unit_vectors(queries.filter(F.size(vec_col) == pivots.shape[1]), query_id, vec_col), n=F.count(F.lit(1)))
    bounds_of = spark.read.parquet(f"{path}/parts").groupBy("part").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    parts = sorted(tuple(r) for r in bounds_of.collect())
    n = seen["n"] or 0
    if n * pivots.shape[1] > max_numbers or n * max(len(parts), len(pivots)) > max_bounds:
        base = stored.select("id", F.col("v").alias("embedding"))
        rows = asked.select(F.col("id").alias("query_id"), F.col("v").alias("embedding"))
        return cosine_topk(rows, base, k, least, max_numbers=max_numbers), []
    schema = f"query_id {asked.schema['id'].dataType.simpleString()}, id {stored.schema['id'].dataType.simpleString()}, similarity double"
    if not n or not parts:
        return spark.createDataFrame([], schema + ", rank int"), []
    table = asked.toArrow()
    ids, matrix = table.column("id").combine_chunks(), _matrix(table.column("v").combine_chunks())
    place = {q: i for i, q in enumerate(ids.to_pylist())}
    part, size, low, high = (np.array(c) for c in zip(*parts))
    angle = np.arccos(np.clip(matrix @ pivots.T, -1, 1))[:, part // SHELLS]
    bound = np.cos(np.maximum(0, np.maximum(low - angle, angle - high))) + SLACK
    order = np.argsort(-bound, axis=1, kind="stable")
    reached = np.full(n, least)
    found, waves, at, width = None, [], 0, first
    while at < len(part):
        wave = order[:, at : at + width]
        asks, col = np.nonzero(np.take_along_axis(bound, wave, 1) >= reached[:, None])
        if not len(asks):
            break
        which = wave[asks, col]
        by_part = np.argsort(which, kind="stable")
        read, starts = np.unique(which[by_part], return_index=True)
        meets = dict(zip(part[read].tolist(), np.split(asks[by_part], starts[1:])))
        rows = _meet(_of_parts(stored, list(meets)), meets, ids, matrix, reached, k, schema)
        more, _ = scratch.write(rows)
        found = more if found is None else found.unionByName(more)
        waves.append(Wave(len(read), int(size[read].sum()), len(asks), n * len(part)))
        at, width = at + width, width * 4
        if at < len(part):
            full = _ranked(found, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("kth")).filter(F.col("n") == k)
            for r in full.collect():
                i = place[r["query_id"]]
                reached[i] = max(reached[i], r["kth"] - SLACK)
    return (_ranked(found, k) if found is not None else spark.createDataFrame([], schema + ", rank int")), waves


def _of_parts(stored: DataFrame, parts: list[int]) -> DataFrame:
    if len(parts) <= MAX_PUSHED:
        return stored.filter(F.col("part").isin(parts))
    spark = stored.sparkSession
    few = stored.filter(F.col("part").between(min(parts), max(parts)))
    return few.join(F.broadcast(spark.createDataFrame([(p,) for p in parts], "part int")), "part", "left_semi")


def _meet(rows: DataFrame, meets: dict, ids, matrix: np.ndarray, reached: np.ndarray, k: int, schema: str) -> DataFrame:
    """k best vectors (and ties) per query and part, at least as near as what the query has reached, in this task too."""
    shipped = rows.sparkSession.sparkContext.broadcast((meets, ids, matrix, reached))

    def run(batches):
        import pyarrow as pa

        meets, ids, matrix, reached = shipped.value
        reached = reached.copy()
        # the k best cosines that this task has found for a query
        top = np.full((len(ids), k), -2.0) if len(ids) * k <= MAX_TOP else None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            part = batch.column("part").to_numpy(zero_copy_only=False)
            v = _matrix(batch.column("v"))
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(edges, edges[1:]):
                own = meets.get(int(part[a]))
                for q in range(0, len(own) if own is not None else 0, TILE):
                    asks = own[q : q + TILE]
                    for x in range(a, b, TILE):
                        sims = matrix[asks] @ v[x : min(b, x + TILE)].T
                        good = sims >= reached[asks][:, None] - 1e-12
                        few = sims
                        if sims.shape[1] > k:
                            few = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k:]
                            good &= sims >= few[:, :1] - SLACK
                        if top is not None:
                            few = np.concatenate([top[asks], few], axis=1)
                            top[asks] = np.partition(few, few.shape[1] - k, axis=1)[:, -k:]
                            reached[asks] = np.maximum(reached[asks], top[asks].min(axis=1) - SLACK)
                        i, j = np.nonzero(good)
                        if len(i):
                            found = [ids.take(pa.array(asks[i])), batch.column("id").take(pa.array(x + j)), pa.array(sims[i, j])]
                            yield pa.RecordBatch.from_arrays(found, names=["query_id", "id", "similarity"])

    return rows.select("id", "v", "part").mapInArrow(run, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
