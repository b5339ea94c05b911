"""Exact ranked search with geometrically blocked posting lists.

*Scores.*  A document is a vector of term impacts ``(10^9 tf) div (1000 tf + 8 m)``, m its length relative to the mean; a query
is a vector of term weights ``floor(1000 ln((2N + 2) / (2 df + 1)))`` times repeats.  The score is their inner product in whole numbers.
*Blocks.*  The posting list of a term is cut into blocks of documents that resemble each other: about one block for
``BLOCK`` postings, each document going to the nearest of as many documents of the list by the cosine of their projected vectors.  A block's
summary is the coordinatewise maximum of its documents' impacts, so query times summary bounds the score of every document in it.
*Search.*  Lists are taken in falling order of the most they can add.  A block is skipped only when its exact bound is below the
k-th best score found so far (equal scores are looked at, as the smaller id wins); all other blocks are scored whole.  Once what the remaining
lists can add together is below that score, no unseen document can enter and the query is done.

One job counts documents, lengths and document frequencies; one map stage per ``QUERY_TERMS`` query terms builds blocks over pieces
of a task's documents (at most ``CELLS`` impacts at once) and searches them, the best scores carried from piece to piece.  A list is blocked when the first
query needs it.  A task emits k rows a query, which meet in two steps, so no query's candidates of all tasks meet in one sort.

Null texts and texts without terms are no documents of the collection and are never found.  Rows that repeat are documents of their own; a null
id comes behind others of its score.  Query rows that repeat are queries of their own (``item_id`` repeats, ranks start anew);
queries without terms, and empty tables, give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pictorium.plans.scratch import Scratch

from .common import row_batches, texts, words_of

K = 10
BLOCK = 64
#: Impacts held at once by a task, and distinct query terms of one map stage.
CELLS = 8_000_000
QUERY_TERMS = 20_000
DIMENSIONS = 32
#: Groups in which the tasks' best rows of a query meet first.
SPREAD = 64


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, df, n): documents with the term.  The row with a null term counts all documents with a term (df) and their terms (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(df, docs, n):
            arrays = [pa.array([*df, None], pa.binary()), pa.array([*df.values(), docs], pa.int64()), pa.array([0] * len(df) + [n], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["term", "df", "n"])

        df, docs, n = Counter(), 0, 0
        for batch in row_batches(batches):
            for text in texts(batch):
                words = words_of(text)
                df.update(set(words))
                docs += bool(words)
                n += len(words)
            if len(df) > 500_000:
                yield out(df, docs, n)
                df, docs, n = Counter(), 0, 0
        yield out(df, docs, n)

    counted = rows.select("text").mapInArrow(run, "term binary, df long, n long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, term, times) of every query row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            rows = [(q, t, n) for q, text in zip(batch.column("query").to_pylist(), texts(batch)) for t, n in Counter(words_of(text)).items()]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int64()))], names=["query", "term", "times"])

    return queries.select("query", "text").mapInArrow(run, "query long, term binary, times long")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Query(NamedTuple):
    number: int
    terms: np.ndarray
    weights: np.ndarray


class Best:
    """The k best (score, id) of one query so far; equal scores by ascending id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score = k, np.zeros(0, np.int64)
        self.id, self.null = np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A score below this cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.least
        if not good.any():
            return
        score, ids, null = (np.concatenate([x, y[good]]) for x, y in ((self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[order], ids[order], null[order]


class Piece:
    """Blocked posting lists over some documents: ``impacts`` is documents x query terms."""

    def __init__(self, impacts: np.ndarray, ids: np.ndarray, null: np.ndarray, weights: np.ndarray, block: int = BLOCK):
        self.impacts, self.ids, self.null, self.block = impacts, ids, null, block
        term, doc = np.nonzero(impacts.T)
        self.docs, self.starts = doc, np.searchsorted(term, np.arange(impacts.shape[1] + 1))
        self.peak = impacts.max(axis=0, initial=0).astype(np.int64)
        plane = np.random.default_rng(12).choice(np.array([-1, 1], np.float32), (impacts.shape[1], DIMENSIONS)) * weights[:, None].astype(np.float32)
        at = impacts.astype(np.float32) @ plane
        self.place = at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-9)
        self.lists: dict[int, tuple[list[np.ndarray], np.ndarray]] = {}
        self.seen_blocks = self.skipped_blocks = self.skipped_lists = self.scored = 0

    def postings(self, term: int) -> np.ndarray:
        return self.docs[self.starts[term] : self.starts[term + 1]]

    def blocks(self, term: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Blocks of a term's list and their summaries."""
        if term not in self.lists:
            docs = self.postings(term)
            n = -(-len(docs) // self.block)
            centres = docs[np.arange(n) * len(docs) // n]
            nearest = (self.place[docs] @ self.place[centres].T).argmax(axis=1)
            order = np.argsort(nearest, kind="stable")
            cuts = np.flatnonzero(np.diff(nearest[order])) + 1
            parts = np.split(docs[order], cuts)
            self.lists[term] = parts, np.stack([self.impacts[p].max(axis=0) for p in parts])
        return self.lists[term]

    def search(self, query: Query, best: Best) -> None:
        terms = query.terms
        adds = query.weights * self.peak[terms]
        order = np.argsort(-adds, kind="stable")
        rest = np.cumsum(adds[order][::-1])[::-1]  # what this list and all behind it can add
        seen = np.zeros(len(self.ids), bool)
        for i, at in enumerate(order):
            if rest[i] < best.least:
                self.skipped_lists += len(order) - i
                break
            docs = self.postings(terms[at])
            if len(docs) <= self.block:  # one block: its summary is the maximum itself
                parts, summary = [docs], self.impacts[np.ix_(docs, terms)].max(axis=0, keepdims=True)
            else:
                parts, full = self.blocks(int(terms[at]))
                summary = full[:, terms]
            bound = summary.astype(np.int64) @ query.weights
            by_bound = np.argsort(-bound, kind="stable")
            self.seen_blocks += len(parts)
            # the most promising block alone, then the others that still pass, in growing steps
            done, step = 0, 1
            while done < len(by_bound):
                chosen = [j for j in by_bound[done : done + step] if bound[j] >= best.least]
                done, step = done + step, step * 2
                if not chosen:
                    break
                self.skipped_blocks -= len(chosen)
                docs = np.concatenate([parts[j] for j in chosen])
                docs = docs[~seen[docs]]
                seen[docs] = True
                self.scored += len(docs)
                score = self.impacts[np.ix_(docs, terms)].astype(np.int64) @ query.weights
                best.add(score, self.ids[docs], self.null[docs])
            self.skipped_blocks += len(parts)


class Counted(NamedTuple):
    """A document's length and its query terms with their numbers."""

    length: int
    terms: list[int]
    times: list[int]


def counted(words: list[bytes], vocabulary: dict[bytes, int]) -> Counted:
    found = [(j, n) for t, n in Counter(words).items() if (j := vocabulary.get(t)) is not None]
    return Counted(len(words), [j for j, _ in found], [n for _, n in found])


def impacts_of(docs: list[Counted], n_vocabulary: int, n_docs: int, n_terms: int) -> np.ndarray:
    """Impacts of documents on the query terms."""
    out = np.zeros((len(docs), n_vocabulary), np.int32)
    rows = np.repeat(np.arange(len(docs)), [len(d.terms) for d in docs])
    if len(rows):
        columns, tf = (np.concatenate([np.array(getattr(d, x), np.int64) for d in docs]) for x in ("terms", "times"))
        m = np.array([25 + 75 * d.length * n_docs // n_terms for d in docs], np.int64)
        out[rows, columns] = 1_000_000_000 * tf // (1000 * tf + 8 * m[rows])
    return out


def _search_step(docs: DataFrame, queries: list[Query], weights: dict[bytes, int], n_docs: int, n_terms: int, k: int, cells: int, block: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((queries, weights))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight_of = shared.value
        vocabulary = {t: j for j, t in enumerate(weight_of)}
        w = np.array(list(weight_of.values()), np.int64)
        best = [Best(k) for _ in asked]
        most = max(1, cells // max(len(vocabulary), 1))

        def search(ids: list, rows: list[Counted]) -> None:
            null = np.array([i is None for i in ids])
            piece = Piece(impacts_of(rows, len(vocabulary), n_docs, n_terms), np.array([i or 0 for i in ids], np.int64), null, w, block)
            for q, b in zip(asked, best):
                piece.search(q, b)

        ids, rows = [], []
        for batch in row_batches(batches):
            for i, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                words = words_of(text)
                if not words:
                    continue
                ids.append(i)
                rows.append(counted(words, vocabulary))
                if len(ids) >= most:
                    search(ids, rows)
                    ids, rows = [], []
        if ids:
            search(ids, rows)
        number = np.repeat([q.number for q in asked], [len(b.score) for b in best])
        found = [np.concatenate([getattr(b, x) for b in best]) for x in ("id", "score", "null")]
        arrays = [pa.array(number, pa.int64()), pa.array(found[0], pa.int64(), mask=found[2]), pa.array(found[1], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["query", "doc_id", "score"])

    return docs.mapInArrow(run, "query long, doc_id long, score long")


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_documents(
    docs: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, cells: int = CELLS, most_terms: int = QUERY_TERMS
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents for every row of ``queries(item_id, text)``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked")
    numbered, _ = scratch.write(queries.select(F.monotonically_increasing_id().alias("query"), "item_id", "text"))
    asked, seen = scratch.write(query_terms(numbered), n=F.count(F.lit(1)))
    counts, _ = scratch.write(term_counts(docs))
    total = counts.filter(F.col("term").isNull()).head()
    empty = spark.createDataFrame([], "query long, doc_id long, score long")
    if total is None or not total["df"]:
        found = empty
    else:
        n_docs, n_terms = total["df"], total["n"]
        terms, _ = scratch.write(asked.join(counts.select("term", "df"), "term"))
        steps = -(-seen["n"] // most_terms)
        found = empty
        for s in range(steps):
            # queries of one step: about most_terms terms
            part = terms.filter(F.pmod(F.xxhash64("query"), F.lit(steps)) == s) if steps > 1 else terms
            weights: dict[bytes, int] = {}
            by_query: dict[int, list[tuple[bytes, int]]] = {}
            for r in part.orderBy("query", "term").toLocalIterator():
                w = weight(n_docs, r["df"])
                if w > 0:
                    weights[bytes(r["term"])] = w
                    by_query.setdefault(r["query"], []).append((bytes(r["term"]), r["times"]))
            at = {t: j for j, t in enumerate(weights)}
            ready = [Query(q, np.array([at[t] for t, _ in ts]), np.array([weights[t] * n for t, n in ts], np.int64)) for q, ts in by_query.items()]
            if ready:
                rows = _search_step(docs, ready, weights, n_docs, n_terms, k, cells, block).withColumn("group", F.spark_partition_id() % SPREAD)
                found = found.unionByName(_top(rows, ["query", "group"], k).drop("rank", "group"))
    best = _top(found, ["query"], k)
    return best.join(numbered.select("query", "item_id"), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: The same by scoring every document that shares a term.
ORACLE_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
        lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS t FROM documents),
    s AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
    p AS (SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY k, doc_id, n, term),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * s.n + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
    i AS (SELECT q, item_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM
      (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
    a AS (SELECT q, item_id, k, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * s.n) // s.l)))) AS BIGINT) AS score
      FROM i JOIN w USING (term) JOIN p USING (term), s GROUP BY q, item_id, k, doc_id),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM a WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""
