"""Vector table: upsert, search, matching, statistics, text vectors."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pictorium.functions.text import plain_tokens
from pictorium.plans.vector_join import cosine_topk

from .common import upsert_latest


def insert_vectors(base: DataFrame, new: DataFrame, dimension: int, version: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """``(table, refused)``: empty vectors and wrong dimensions are refused,
    the rest replace rows of the same id."""
    fits = F.size("embedding") == dimension
    return upsert_latest(base, new.filter(fits), ["id"], version), new.filter(~F.coalesce(fits, F.lit(False)))


def search_vectors(queries: DataFrame, base: DataFrame, k: int, min_similarity: float = 0.0, **options) -> DataFrame:
    return cosine_topk(queries, base, k, min_similarity, **options)


def delete_vector(base: DataFrame, vector_id) -> DataFrame:
    return base.filter(~F.col("id").eqNullSafe(vector_id))


def vector_stats(base: DataFrame, dimension: int) -> DataFrame:
    id_bytes = F.octet_length(F.col("id").cast("string"))
    meta = F.coalesce(F.octet_length("metadata"), F.lit(0)) if "metadata" in base.columns else F.lit(0)
    size = F.size("embedding").cast("long") * 4 + id_bytes + meta
    return base.agg(
        F.count(F.lit(1)).alias("total_vectors"),
        F.lit(dimension).cast("long").alias("dimension"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("size_bytes"),
    )


def match_registered(queries: DataFrame, registry: DataFrame, threshold: float, **options) -> DataFrame:
    """Best registered vector per query with a similarity above 0 and at least
    ``threshold``; NULL when nothing matches."""
    floor = max(threshold, 1e-12)
    best = cosine_topk(queries, registry, 1, floor, **options).drop("rank").withColumnRenamed("id", "match_id")
    return queries.select("query_id").join(best, "query_id", "left")


def text_vectors(rows: DataFrame, id_col: str, text_col: str, dimension: int = 512) -> DataFrame:
    """``(id, index, value)``: signed feature hashing of the tokens, scaled to
    unit length, as sparse rows.  A token's md5 gives its index (first four
    hex digits) and sign (fifth).  The tokens of a row are added up where it is read; rows of one id meet in a shuffle of these sums."""
    tokens = rows.select(F.col(id_col).alias("id"), plain_tokens(F.col(text_col)).alias("tokens"))
    id_type = tokens.schema["id"].dataType.simpleString()

    def count(batches):
        import numpy as np
        import pyarrow as pa

        seen: dict[bytes, int] = {}
        for batch in (b.slice(at, TEXT_ROWS) for b in batches for at in range(0, b.num_rows, TEXT_ROWS)):
            if len(seen) > 500_000:
                seen.clear()
            words, sizes = _cells_of(batch, "tokens")
            words = words.dictionary_encode()
            slots = np.array([_signed_slot(w, seen) for w in words.dictionary.cast(pa.binary()).to_pylist()], np.int64)
            slots = slots[words.indices.to_numpy(zero_copy_only=False)] if len(slots) else slots
            place = np.repeat(np.arange(len(sizes)), sizes) * dimension + (slots >> 1) % dimension
            totals = np.bincount(place, weights=1.0 - 2 * (slots & 1), minlength=len(sizes) * dimension)
            place = np.flatnonzero(totals)
            ends = np.searchsorted(place, np.arange(len(sizes) + 1) * dimension).astype(np.int32)
            cells = [pa.array((place % dimension).astype(np.int32)), pa.array(totals[place].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.ListArray.from_arrays(ends, c) for c in cells)], names=["id", "index", "total"])

    def scale(batches):
        import numpy as np
        import pyarrow as pa

        def cells(batch):
            index, sizes = _cells_of(batch, "index")
            return np.repeat(np.arange(len(sizes)), sizes), index.to_numpy(), _cells_of(batch, "total")[0].to_numpy()

        for ids, totals in _matrices(batches, dimension, cells):
            row, index = np.nonzero(totals)
            value = totals[row, index] / np.sqrt((totals * totals).sum(1))[row]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(index), pa.array(value)], names=["id", "index", "value"])

    counted = tokens.mapInArrow(count, f"id {id_type}, index array<int>, total array<long>").filter(F.size("index") > 0)
    return counted.repartition("id").sortWithinPartitions("id").mapInArrow(scale, f"id {id_type}, index long, value double")


def dense_text_vectors(sparse: DataFrame, dimension: int = 512) -> DataFrame:
    """``(id, embedding)`` from sparse rows (at most ``dimension`` per id)."""
    id_type = sparse.schema["id"].dataType.simpleString()

    def fill(batches):
        import numpy as np
        import pyarrow as pa

        def cells(batch):
            return np.arange(batch.num_rows), batch.column("index").to_numpy(), batch.column("value").fill_null(0.0).to_numpy()

        for ids, values in _matrices(batches, dimension, cells):
            ends = np.arange(len(ids) + 1, dtype=np.int32) * dimension
            filled = pa.ListArray.from_arrays(ends, pa.array(values.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([ids, filled], names=["id", "embedding"])

    rows = sparse.select("id", F.col("index").cast("long").alias("index"), F.col("value").cast("double").alias("value"))
    return rows.repartition("id").sortWithinPartitions("id").mapInArrow(fill, f"id {id_type}, embedding array<float>")


#: Rows of one matrix of texts by slots.
TEXT_ROWS = 2048


def _signed_slot(token: bytes, seen: dict[bytes, int]) -> int:
    """Twice the first four hex digits of the md5, and whether the fifth is odd."""
    slot = seen.get(token)
    if slot is None:
        digits = hashlib.md5(token, usedforsecurity=False).hexdigest()
        slot = seen[token] = 2 * int(digits[:4], 16) + int(digits[4], 16) % 2
    return slot


def _cells_of(batch, name: str):
    """Elements of a list column, and how many each row has."""
    import numpy as np

    column = batch.column(name)
    return column.flatten(), np.diff(column.offsets.to_numpy())


def _matrices(batches, dimension: int, cells):
    """``(ids, sums by slot)`` of batches sorted by id, every id once: the last one of a batch may go on in the next.
    ``cells`` gives row, slot and value of a batch's cells; slots beyond the dimension are left out."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    last, held = None, None
    for batch in (b.slice(at, TEXT_ROWS) for b in batches for at in range(0, b.num_rows, TEXT_ROWS)):
        runs = pc.run_end_encode(batch.column("id"))
        ids, ends = runs.values, runs.run_ends.to_numpy()
        row, slot, value = cells(batch)
        inside = (slot >= 0) & (slot < dimension)
        place = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))[row[inside]] * dimension + slot[inside]
        sums = np.bincount(place, weights=value[inside], minlength=len(ids) * dimension).reshape(-1, dimension)
        if held is not None and last[0].as_py() == ids[0].as_py():
            sums[0] += held
        elif held is not None:
            yield last, held[None, :]
        last, held = ids[-1:], sums[-1].copy()
        yield ids[:-1], sums[:-1]
    if held is not None:
        yield last, held[None, :]
