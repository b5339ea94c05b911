"""Exact cosine joins with numpy blocks inside Spark tasks.

Vectors are scaled to unit length once.  Candidate pairs are checked as matrix
products over Arrow batches, so no pair that fails the threshold ever becomes a
row.

``cosine_pairs`` prunes by pivots: each vector lives in the cell of its nearest
pivot.  If ``|x - y| <= r`` and their cells ``i < j`` differ, then ``y`` is
within ``r`` of the hyperplane between the pivots, so sending ``y`` to cell
``i`` in that case (and only then) finds every pair exactly once.  Cells are cut
into stripes, and every pair of stripes is one task.  Vectors without clusters would visit about half of the cells; a sample tells, and they are cut
into stripes without cells.

Stripes are as large as a task can hold while every core has work, so a vector
travels to few tasks: what is moved grows with the rows, until a stripe is full.
Products are made in parts of at most ``SIMS`` similarities, which bounds each
task's memory however large or skewed stripes are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictorium.functions.vectors import l2_normalize, norm

from .scratch import Scratch

BLOCK = 4096
MAX_PIVOTS = 4096
# vectors that tell whether pivots pay; copies of a vector that are no matter
PROBES, FEW_STRIPES = 512, 8
# a broadcast query matrix holds at most this many numbers (64 MB of doubles)
MAX_BROADCAST_NUMBERS = 8_000_000
# similarities of one product (32 MB of doubles); numbers in a stripe of vectors (64 MB); numbers of a batch of the base
SIMS, STRIPE_NUMBERS, CHUNK_NUMBERS = 1 << 22, 8_000_000, 2_000_000
# rows that a broadcast query set may find in each task; bytes of one
MAX_FOUND, FOUND_BYTES = 1 << 21, 24
# how far rounding may move a product; numbers of the found pairs that are multiplied once more at a time (16 MB)
ROUNDING, AGAIN_NUMBERS = 1e-9, 2_000_000


def _tasks(spark) -> int:
    return 4 * spark.sparkContext.defaultParallelism


def _self_stripe(rows: int, dimension: int, block: int, tasks: int) -> int:
    """Rows of a stripe where ``rows`` meet themselves: at least a block."""
    return max(block, min(STRIPE_NUMBERS // max(dimension, 1), math.ceil(rows / math.sqrt(2 * tasks))))


def _grid(left: tuple[int, int], right: tuple[int, int], k: int, block: int, tasks: int) -> tuple[int, int]:
    """Stripes of the left and the right side, each ``(rows, numbers)``: of all numbers of stripes that fit and give every core work,
    those that move least, which is vectors to every stripe of the other side and ``k`` rows per left row and right stripe."""
    (n, numbers), (m, others) = left, right
    fits = lambda x: max(1, math.ceil(x / STRIPE_NUMBERS))
    most = lambda x: max(1, math.ceil(x / block))
    best = None
    for q in range(fits(others), max(fits(others), min(most(m), tasks)) + 1):
        p = max(fits(numbers), min(most(n), math.ceil(tasks / q)))
        cost = 8 * (numbers * q + others * p) + n * min(k, math.ceil(m / q)) * q * FOUND_BYTES
        if best is None or cost < best[0]:
            best = cost, p, q
    return best[1:]


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)`` with unit vectors; empty and all-zero vectors match nothing
    (their cosine is 0) and are left out."""
    usable = vectors.filter((F.size(vec_col) > 0) & (norm(F.col(vec_col)) > 0))
    return usable.select(F.col(id_col).alias("id"), l2_normalize(F.col(vec_col)).alias("v"))


def _visits(sims, gaps, radius: float):
    """Home cell of every vector, and the earlier cells it must visit as well, from its cosines with the pivots."""
    import numpy as np

    home = sims.argmax(axis=1)
    # |y-p_i|² - |y-p_h|² = 2 (s_h - s_i) for unit vectors
    margin = (sims[np.arange(len(home)), home][:, None] - sims) / gaps[home]
    return home, (margin <= radius + 1e-9) & (np.arange(sims.shape[1])[None, :] < home[:, None])


def _gaps(pivots):
    import numpy as np

    return np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 1e-300))


def _pivots_pay(pivots, probes, radius: float, stripes: int) -> bool:
    """Whether cells move fewer vectors than plain stripes, which move each to every stripe.  In cells one is written and
    moved with every visit; without clusters that is half of the cells, so it grows with the square of the vectors."""
    if not len(probes):
        return True
    _, visits = _visits(probes @ pivots.T, _gaps(pivots), radius)
    return 2 * (1 + visits.sum(axis=1).mean()) <= max(stripes, FEW_STRIPES)


def _place_in_cells(units: DataFrame, pivots, radius: float) -> DataFrame:
    """Rows ``(id, v, cell, resident)``."""
    id_type = units.schema["id"].dataType.simpleString()
    shipped = units.sparkSession.sparkContext.broadcast(pivots)

    def place(batches):
        import numpy as np
        import pyarrow as pa

        pivots = shipped.value
        gaps = _gaps(pivots)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column("v")
            sims = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) @ pivots.T
            home, visits = _visits(sims, gaps, radius)
            who, where = np.nonzero(visits)
            take = pa.array(np.concatenate([np.arange(len(home)), who]))
            cell = np.concatenate([home, where]).astype("int32")
            resident = np.concatenate([np.ones(len(home), bool), np.zeros(len(who), bool)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), column.take(take), pa.array(cell), pa.array(resident)],
                names=["id", "v", "cell", "resident"],
            )

    return units.mapInArrow(place, f"id {id_type}, v array<double>, cell int, resident boolean")


def _similarity(x, y):
    """Cosines of rows of unit vectors.  A matrix product rounds by the place of a row in it; these are the same for all copies of two
    vectors, wherever they meet, and 1 between copies."""
    import numpy as np

    similarity = np.clip((x * y).sum(axis=1), -1.0, 1.0)
    close = np.flatnonzero(similarity > 1 - ROUNDING)
    similarity[close[(x[close] == y[close]).all(axis=1)]] = 1.0
    return similarity


def cosine_pairs(
    vectors: DataFrame,
    threshold: float,
    id_col: str = "id",
    vec_col: str = "embedding",
    block: int = BLOCK,
    pivots: int | None = None,
) -> DataFrame:
    """All pairs ``(a, b, similarity)``, ``a < b``, with cosine >= threshold.
    Vectors of different length have similarity 0, so every length is joined by itself.  ``block`` is the least number of rows of a stripe."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    lengths = [r[0] for r in vectors.filter(F.size(vec_col) > 0).select(F.size(vec_col)).distinct().collect()]  # a few
    parts = [_pairs_of_one_length(vectors.filter(F.size(vec_col) == n), threshold, id_col, vec_col, block, pivots) for n in sorted(lengths) or [1]]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _pairs_of_one_length(vectors: DataFrame, threshold: float, id_col: str, vec_col: str, block: int, pivots: int | None) -> DataFrame:
    scratch = Scratch(vectors.sparkSession, "vectors")
    units, seen = scratch.write(unit_vectors(vectors, id_col, vec_col), n=F.count(F.lit(1)), numbers=F.sum(F.size("v").cast("long")))
    id_type = units.schema["id"].dataType.simpleString()
    schema = f"a {id_type}, b {id_type}, similarity double"
    if not seen["n"]:
        return vectors.sparkSession.createDataFrame([], schema)
    stripe = _self_stripe(seen["n"], seen["numbers"] // seen["n"], block, _tasks(vectors.sparkSession))
    wanted = min(MAX_PIVOTS, math.ceil(seen["n"] / block)) if pivots is None else pivots
    placed = None
    if wanted > 1:
        import numpy as np

        # at most MAX_PIVOTS + PROBES vectors reach the driver; being a sample, they
        # lie densest where the vectors do
        probes = PROBES if pivots is None else 0
        sample = np.array([r["v"] for r in units.orderBy(F.xxhash64("id"), "id").limit(wanted + probes).select("v").collect()])
        centre = np.unique(sample[:wanted], axis=0)
        radius = math.sqrt(max(2 - 2 * threshold, 0.0))
        if pivots is not None or _pivots_pay(centre, sample[wanted:], radius, math.ceil(seen["n"] / stripe)):
            placed, _ = scratch.write(_place_in_cells(units, centre, radius))
    if placed is None:
        placed = units.select("id", "v", F.lit(0).alias("cell"), F.lit(True).alias("resident"))

    # stripes per cell, from counts combined on the map side (<= MAX_PIVOTS rows)
    sizes = F.broadcast(
        placed.groupBy("cell").agg(
            F.ceil(F.count_if("resident") / stripe).alias("rb"),
            F.ceil(F.count_if(~F.col("resident")) / stripe).alias("vb"),
        )
    )
    sized = placed.join(sizes, "cell")
    zero = F.lit(0).cast("long")
    own = F.pmod(F.xxhash64("id"), F.greatest(F.when(F.col("resident"), F.col("rb")).otherwise(F.col("vb")), F.lit(1)))
    sized = sized.withColumn("own", own)
    none = F.array().cast("array<struct<l:bigint,r:bigint,left:boolean>>")

    def cells(rows, pair):
        return F.when(rows, pair).otherwise(none)

    def spot(l: Column, r: Column, left: bool) -> Column:
        return F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"), F.lit(left).alias("left"))

    # residents meet residents of stripes l <= r, visitors sit in stripes r >= rb
    me = F.col("own")
    upto = F.col("rb") - 1
    as_left = F.transform(F.sequence(me, upto), lambda r: spot(me, r, True))
    as_right = F.transform(F.sequence(zero, F.greatest(me - 1, zero)), lambda l: spot(l, me, False))
    as_right = cells(me > 0, as_right)
    to_visitors = cells(
        F.col("vb") > 0,
        F.transform(F.sequence(zero, F.greatest(F.col("vb") - 1, zero)), lambda x: spot(me, F.col("rb") + x, True)),
    )
    visiting = cells(
        F.col("rb") > 0,
        F.transform(F.sequence(zero, F.greatest(upto, zero)), lambda l: spot(l, F.col("rb") + me, False)),
    )
    spots = F.when(F.col("resident"), F.concat(as_left, as_right, to_visitors)).otherwise(visiting)
    tasks = sized.select("id", "v", "cell", F.inline(spots))

    def compare(batches):
        table = pa.Table.from_batches(batches)
        left = table.filter(table.column("left"))
        right = table.filter(pa.compute.invert(table.column("left")))
        inside = right.num_rows == 0 and table.num_rows > 0 and table.column("l")[0] == table.column("r")[0]
        if inside:
            right = left
        if left.num_rows == 0 or right.num_rows == 0:
            return
        ids, others = left.column("id").combine_chunks(), right.column("id").combine_chunks()
        lv, rv = (side.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(side.num_rows, -1) for side in (left, right))
        step = max(1, SIMS // len(rv))
        for at in range(0, len(lv), step):
            start = at if inside else 0
            sims = lv[at : at + step] @ rv[start:].T
            if inside:
                sims[np.tril_indices(len(sims), 0, sims.shape[1])] = -2.0
            i, j = np.nonzero(sims >= threshold - ROUNDING)
            some = max(1, AGAIN_NUMBERS // rv.shape[1])
            for first in range(0, len(i), some):
                x, y = i[first : first + some] + at, j[first : first + some] + start
                similarity = _similarity(lv[x], rv[y])
                good = similarity >= threshold
                a, b = ids.take(pa.array(x[good])), others.take(pa.array(y[good]))
                swap = pa.compute.greater(a, b)
                found = [pa.compute.if_else(swap, b, a), pa.compute.if_else(swap, a, b), pa.array(similarity[good])]
                yield pa.RecordBatch.from_arrays(found, names=["a", "b", "similarity"])

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    compare.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return tasks.groupBy("cell", "l", "r").applyInArrow(compare, schema)


class _Vectors:
    """Ids and vectors of an Arrow batch, by length."""

    def __init__(self, batch):
        import numpy as np

        self.ids = batch.column("id")
        if hasattr(self.ids, "combine_chunks"):
            self.ids = self.ids.combine_chunks()
        column = batch.column("v")
        if hasattr(column, "combine_chunks"):
            column = column.combine_chunks()
        flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
        ends = np.cumsum(sizes)
        self.n, self.parts = len(sizes), {}
        if self.n and (sizes == sizes[0]).all():  # no copies of a large matrix
            if sizes[0]:
                self.parts[int(sizes[0])] = (np.arange(self.n), flat.reshape(self.n, -1))
            return
        for size in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == size)
            self.parts[int(size)] = (rows, flat[(ends[rows] - size)[:, None] + np.arange(size)])


def _similarities(left: _Vectors, right: _Vectors, a: int, rows: int):
    """Cosines of some rows with all others: 0 where the lengths differ or a vector is empty or zero."""
    import numpy as np

    out = np.zeros((min(rows, left.n - a), right.n))
    for size in left.parts.keys() & right.parts.keys():
        (i, x), (j, y) = left.parts[size], right.parts[size]
        p = np.searchsorted(i, (a, a + rows))
        if len(j) == right.n:
            out[i[p[0] : p[1]] - a] = x[p[0] : p[1]] @ y.T
        else:
            out[np.ix_(i[p[0] : p[1]] - a, j)] = x[p[0] : p[1]] @ y.T
    return np.fmax(out, -2.0, out=out)  # NaN is like nothing


def _k_best(sims, k: int):
    """Marks the k best of every row; columns are in the order of their ids.  Those that rounding may move past the k-th stay as well, but
    of equal similarities the first k are enough."""
    import numpy as np

    kth = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k, None]
    good = sims >= kth - 1e-9
    many = np.flatnonzero(good.sum(axis=1) > k)
    if len(many):
        tied = sims[many] == kth[many]
        good[many] &= ~tied | (np.cumsum(tied, axis=1, dtype=np.int32) <= k)
    return good


def _by_id(table):
    """The table, and its vectors, in the order of the ids (nulls first, as Spark sorts)."""
    import pyarrow.compute as pc

    return _Vectors(table.take(pc.sort_indices(table.column("id"), null_placement="at_start")))


def _chunks(batches):
    """Arrow batches put together to tables of ``CHUNK_NUMBERS`` or a batch more."""
    import pyarrow as pa

    held, numbers = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            numbers += batch.num_rows + len(batch.column("v").flatten())
            if numbers >= CHUNK_NUMBERS:
                yield pa.Table.from_batches(held)
                held, numbers = [], 0
    if held:
        yield pa.Table.from_batches(held)


#: Queries of one product at most.
TILE = 2048


def _all_unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)``: unit vectors; a null, empty or all-zero one is empty."""
    some = (F.size(vec_col) > 0) & (norm(F.col(vec_col)) > 0)
    return vectors.select(F.col(id_col).alias("id"), F.when(some, l2_normalize(F.col(vec_col))).otherwise(F.array().cast("array<double>")).alias("v"))


def cosine_topk(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    min_similarity: float = 0.0,
    query_id: str = "query_id",
    id_col: str = "id",
    vec_col: str = "embedding",
    max_numbers: int = MAX_BROADCAST_NUMBERS,
    block: int = BLOCK,
    tile: int = TILE,
) -> DataFrame:
    """``(query_id, id, similarity, rank)``: the k most similar base vectors of
    every query with cosine >= ``min_similarity``; ties go to the smaller id.
    Vectors of different length, and empty or all-zero ones, have similarity 0.

    A query set whose matrix stays under ``max_numbers``, and which finds few rows, travels to the tasks, which scan the base once
    and keep k rows per query.  A larger set is met in pairs of stripes instead, of ``block`` rows at least.  At most ``tile`` queries,
    and ``SIMS`` similarities, are in a product, whatever the size of a batch.  The final top-k sees k rows per query and task.
    """
    from pyspark.sql import Window

    spark = base.sparkSession
    scratch = Scratch(spark, "topk")
    asked, seen = scratch.write(
        _all_unit_vectors(queries, query_id, vec_col), n=F.count(F.lit(1)), numbers=F.sum(F.size("v").cast("long") + 1)
    )
    # a vector of similarity 0 can only be wanted when the minimum allows it
    units = (_all_unit_vectors if min_similarity <= 0 else unit_vectors)(base, id_col, vec_col)
    q_type = asked.schema["id"].dataType.simpleString()
    id_type = units.schema["id"].dataType.simpleString()
    schema = f"query_id {q_type}, id {id_type}, similarity double"

    def best(left, right):
        """k best per query, as Arrow batches; the right side is in the order of its ids."""
        import numpy as np
        import pyarrow as pa

        step = max(1, min(tile, SIMS // max(right.n, 1)))
        for a in range(0, left.n, step):
            sims = _similarities(left, right, a, step)
            good = sims >= min_similarity
            if sims.shape[1] > k:
                good &= _k_best(sims, k)
            rows, cols = np.nonzero(good)
            yield pa.RecordBatch.from_arrays(
                [left.ids.take(pa.array(rows + a)), right.ids.take(pa.array(cols)), pa.array(sims[rows, cols])],
                names=["query_id", "id", "similarity"],
            )

    if not seen["n"]:
        found = spark.createDataFrame([], schema)
    elif (seen["numbers"] or 0) <= max_numbers and seen["n"] * k <= MAX_FOUND:
        shipped = spark.sparkContext.broadcast(asked.toArrow())

        def scan(batches):
            left = _Vectors(shipped.value)
            for table in _chunks(batches):
                yield from best(left, _by_id(table))

        found = units.mapInArrow(scan, schema)
    else:
        stored, base_seen = scratch.write(units, n=F.count(F.lit(1)), numbers=F.sum(F.size("v").cast("long") + 1))
        sides = (seen["n"], seen["numbers"]), (base_seen["n"], base_seen["numbers"] or 0)
        qb, bb = _grid(*sides, k, block, _tasks(spark))

        def placed(side, own, other, n_own, n_other, is_query):
            rows = side.select(
                "id",
                "v",
                F.pmod(F.xxhash64("id"), F.lit(n_own)).alias(own),
                F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))).alias(other),
                F.lit(is_query).alias("asks"),
            )
            return rows.repartition(2 * qb * bb, "p", "q")  # a given number is not coalesced: each pair is much work

        q_side = placed(asked, "p", "q", qb, bb, True).groupBy("p", "q")
        b_side = placed(stored, "q", "p", bb, qb, False).groupBy("p", "q")

        def meet(left, right):
            import pyarrow as pa

            kinds = [("query_id", left.schema.field("id").type), ("id", right.schema.field("id").type), ("similarity", pa.float64())]
            if left.num_rows == 0 or right.num_rows == 0:
                return pa.schema(kinds).empty_table()
            return pa.Table.from_batches(best(_Vectors(left), _by_id(right)), pa.schema(kinds))

        found = q_side.cogroup(b_side).applyInArrow(meet, schema)

    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
