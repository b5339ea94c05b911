"""Toxic passages by maximum-scoring segments.

*Token scores.*  Log-odds of a word in toxic against clean documents, with an
informative Dirichlet prior (the words' shares in both together, counted ``prior`` strong; a word counts
once per document and once per group of near copies).  A word
counts with the near end of its interval of ``z`` standard deviations, so rare words stay neutral; every token
also costs ``drift``, which makes the mean score of clean text negative.
*Segments.*  A linear-time scan finds all maximal scoring segments of a text:
passages that can be neither extended nor shortened without losing score.
*Extreme values.*  In clean text the best segment of n tokens follows
``P(S >= x) = 1 - exp(-K n exp(-lambda x))``: lambda solves ``sum p(w) exp(lambda s(w)) = 1`` over clean words,
K is its maximum-likelihood value on clean documents.  A document's evidence is the sum statistic of its ``BEST``
best segments: each adds ``ln(1 + 1 / E)`` with ``E = K n exp(-lambda s)``, so weak segments add a little and none is cut off.
Logistic calibration turns the best segment's share and the sum into a probability.  Passages with E of at most ``E_MAX`` are reported.

The fit uses a bounded, documented sample of labelled rows outside the held-out fold: three quarters for the word scores, one quarter for
K and the calibration.  ``CHOICES`` of (z, prior, drift) are compared on that quarter by the log-loss of calibrations fitted on its one half and
judged on the other, both ways; the least wins (of equal ones the first).  At most ``MAX_WORDS`` word scores are broadcast (the largest).  Scoring is
map-only over all documents.

Null counts as empty; a text without words has no passage and gets the score of no evidence.  Rows repeat as
they are.  Without labelled rows of both kinds the score is their share of ones (0 without any).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .calibration import logistic
from .common import OWN, crc_mod, row_batches, schema_plus, single, texts, with_columns, words_of
from .sampling import SAMPLE_ROWS, labelled_sample

#: (z, prior, drift) to choose from.
CHOICES = tuple((z, prior, drift) for prior in (10_000.0, 30_000.0, 100_000.0) for z in (0.7, 1.0, 1.3) for drift in (0.5, 0.9))
MOST = 6.0
MAX_WORDS = 20_000
BEST = 5
E_MAX = 0.01
FOLD, HELD_OUT, THRESHOLD = 3, 1, 0.7


class Segment(NamedTuple):
    start: int
    end: int
    score: float


def maximal_segments(scores: list[float]) -> list[Segment]:
    """All maximal scoring segments, left to right, in linear time.

    Candidates lie on a stack with the sums before and after them; ``lower`` is the nearest
    earlier candidate with a smaller sum before it, so no candidate is looked at again and again."""
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, lower
    before = 0.0
    for i, (s, after) in enumerate(zip(scores, accumulate(scores))):
        if s > 0:
            start, left = i, before
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][2] >= left:
                    j = stack[j][4]
                if j < 0 or stack[j][3] >= after:
                    stack.append((start, i + 1, left, after, j))
                    break
                start, left = stack[j][0], stack[j][2]
                del stack[j:]
        before = after
    return [Segment(a, b, right - left) for a, b, left, right, _ in stack]


class Model(NamedTuple):
    words: dict
    drift: float
    lam: float
    log_k: float
    weights: np.ndarray
    constant: float | None = None

    def token_scores(self, words: list[bytes]) -> list[float]:
        get, rest = self.words.get, -self.drift
        return [get(w, rest) for w in words]

    def segments(self, words: list[bytes]) -> list[tuple[Segment, float]]:
        """All maximal segments with the natural logarithm of their E-value."""
        if not words:
            return []
        at = self.log_k + math.log(len(words))
        return [(s, at - self.lam * s.score) for s in maximal_segments(self.token_scores(words))]

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        """Of rows of :func:`evidence`."""
        if self.constant is not None:
            return np.full(len(evidence), self.constant)
        x = np.column_stack([evidence, np.ones(len(evidence))])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def evidence(ln_e: list[float]) -> tuple[float, float, float]:
    """Of a document's logarithms of E-values: the best segment's share, the sum over the ``BEST`` best, and the sum up
    to a limit, as a long toxic text is no more toxic."""
    shares = np.logaddexp(0, -np.sort(np.asarray(ln_e, float))[:BEST])
    total = float(shares.sum())
    return (math.log1p(shares[0]) if len(shares) else 0.0, math.log1p(total), min(total, 50.0) / 10)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, y1, y0): numbers of toxic and clean rows with the word, added up
    per task first.  Rows, not tokens: a passage repeated in one text counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts):
            keys = list(counts[0].keys() | counts[1].keys())
            arrays = [pa.array(keys, pa.binary()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["word", "y1", "y0"])

        counts = (Counter(), Counter())
        for batch in row_batches(batches):
            for text, y in zip(texts(batch), batch.column("y").to_pylist()):
                counts[y].update(set(words_of(text)))
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield out(counts)
                counts = (Counter(), Counter())
        yield out(counts)

    found = rows.select("text", "y").mapInArrow(run, "word binary, y1 long, y0 long")
    return found.groupBy("word").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))


def without_copies(rows: DataFrame) -> DataFrame:
    """Rows of the sample, about one of each group of near copies: rows with an equal minimum over hashed
    five-word shingles are one, for two hash functions in turn.  Otherwise the words of a
    text with many copies would pass for typical."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            keys: list[list[int]] = [[], []]
            for text in texts(batch):
                w = words_of(text)
                shingles = {b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}
                for k, seed in zip(keys, (0, 0x9E3779B9)):
                    k.append(min(zlib.crc32(x, seed) * 0x9E3779B1 & 0xFFFFFFFF for x in shingles))
            yield with_columns(batch, batch.schema.names, k0=pa.array(keys[0], pa.int64()), k1=pa.array(keys[1], pa.int64()))

    keyed = rows.mapInArrow(run, schema_plus(rows, rows.columns, k0="long", k1="long"))
    # the smallest id stays, so that a task that runs again keeps the same row
    for k in ("k0", "k1"):
        first = Window.partitionBy(k).orderBy("doc_id")
        keyed = keyed.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    return keyed.drop("k0", "k1")


def word_scores(counts: DataFrame, n1: int, n0: int, z: float, prior: float, drift: float) -> DataFrame:
    """(word, score, y0) of words that are not neutral."""
    alpha = prior * (F.col("y1") + F.col("y0")) / (n1 + n0)
    a1, a0 = F.col("y1") + alpha, F.col("y0") + alpha
    odds = F.log(a1 / (n1 + prior - a1)) - F.log(a0 / (n0 + prior - a0))
    spread = z * F.sqrt(1 / a1 + 1 / a0)
    near = F.when(odds > spread, F.least(odds - spread, F.lit(MOST))).when(odds < -spread, F.greatest(odds + spread, F.lit(-MOST)))
    return counts.select("word", (near - drift).alias("score"), "y0").filter(F.col("score").isNotNull())


def solve_lambda(scores: np.ndarray, shares: np.ndarray, drift: float) -> float:
    """Positive root of ``sum shares * exp(lambda * scores) = 1`` (the rest of the
    shares has score -drift)."""
    rest = max(1 - shares.sum(), 0.0)
    total = lambda x: float((shares * np.exp(x * scores)).sum() + rest * math.exp(-x * drift))
    lo, hi = 1e-3, 1.0
    while total(hi) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if total(mid) < 1 else (lo, mid)
    return lo


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", fold: int = FOLD, held_out: int = HELD_OUT, most: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows outside the held-out fold."""
    from pictorium.plans.scratch import materialize

    sample = labelled_sample(docs, labels, target, fold, held_out, most)
    part = F.abs(F.xxhash64("doc_id", F.lit("part"))) % 4
    sample = materialize(without_copies(sample).withColumn("part", part), "toxic-sample")
    share = sample.agg(F.avg("y")).head()[0]
    neutral = Model({}, 1.0, 1.0, 0.0, np.zeros(4), 0.0 if share is None else share)
    if share in (None, 0.0, 1.0):
        return neutral
    counts = materialize(word_counts(sample.filter("part > 0")), "toxic-words")
    total = counts.agg(F.coalesce(F.sum("y1"), F.lit(0)), F.coalesce(F.sum("y0"), F.lit(0))).head()
    n1, n0 = total[0], total[1]
    if not n1 or not n0:
        return neutral
    models = []
    for z, prior, drift in CHOICES:
        top = word_scores(counts, n1, n0, z, prior, drift).orderBy(F.abs("score").desc(), "word").limit(MAX_WORDS).collect()
        words = {bytes(r["word"]): r["score"] for r in top}
        lam = solve_lambda(np.array([r["score"] for r in top]), np.array([r["y0"] for r in top]) / n0, drift)
        models.append(Model(words, drift, lam, 0.0, np.zeros(4)))
    shared = docs.sparkSession.sparkContext.broadcast([tuple(m) for m in models])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per row and choice the scores of the best segments."""
        candidates = [Model(*m) for m in shared.value]
        kind = pa.list_(pa.list_(pa.float64()))
        for batch in row_batches(batches):
            found = [words_of(t) for t in texts(batch)]
            scores = [[sorted((s.score for s in maximal_segments(m.token_scores(w))), reverse=True)[:BEST] for m in candidates] for w in found]
            yield with_columns(batch, ["doc_id", "y"], n=pa.array([len(w) for w in found], pa.int64()), scores=pa.array(scores, kind))

    rest = sample.filter("part = 0").select("doc_id", "text", "y")
    held = rest.mapInArrow(best, schema_plus(rest, ["doc_id", "y"], n="long", scores="array<array<double>>")).toPandas()  # a part of the bounded sample
    held = held[held["n"] > 0].sort_values("doc_id")
    y, half = held["y"].to_numpy(float), np.arange(len(held)) % 2
    if not len(held) or len(set(y)) < 2:
        return neutral
    fitted = [_calibrated(m, held["n"].to_numpy(), [s[k] for s in held["scores"]], y) for k, m in enumerate(models)]
    losses = [_loss(x, y, half) for _, x in fitted]
    model, x = fitted[int(np.argmin(losses))]
    return model._replace(weights=logistic(x, y))


def _calibrated(model: Model, n: np.ndarray, scores: list, y: np.ndarray) -> tuple[Model, np.ndarray]:
    """The model with K from the clean rows, and the evidence of all rows."""
    peak = np.array([s[0] if len(s) else 0.0 for s in scores])
    clean = y == 0
    log_k = math.log(clean.sum()) - math.log(float((n[clean] * np.exp(-model.lam * peak[clean])).sum()))
    x = np.array([evidence([log_k + math.log(k) - model.lam * v for v in s]) for k, s in zip(n, scores)])
    return model._replace(log_k=log_k), x


def _loss(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> float:
    """Log-loss of every half under the calibration of the other; infinite where a half has one kind only."""
    total = 0.0
    for k in (0, 1):
        fit_on, judged = half == k, half != k
        if len(set(y[fit_on])) < 2:
            return math.inf
        z = np.clip(np.column_stack([x, np.ones(len(x))])[judged] @ logistic(x[fit_on], y[fit_on]), -30, 30)
        total += float(np.logaddexp(0, np.where(y[judged] > 0, -z, z)).sum())
    return total


def scan_toxicity(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (doc_id alone by default), ``score``, and ``passages``: word positions
    [start, end), segment score and ln E of every significant passage."""
    keep = keep or ["doc_id"]
    score, passages = (OWN + "score", OWN + "passages")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("ln_e", pa.float64())]))
        for batch in row_batches(batches):
            found = [m.segments(words_of(t)) for t in texts(batch)]
            seen = np.array([evidence([e for _, e in f]) for f in found]).reshape(-1, 3)
            rows = [[{"start": s.start, "end": s.end, "score": s.score, "ln_e": e} for s, e in f if e <= math.log(E_MAX)] for f in found]
            yield with_columns(batch, keep, **{score: pa.array(m.probability(seen), pa.float64()), passages: pa.array(rows, kind)})

    schema = schema_plus(docs, keep, **{score: "double", passages: "array<struct<start:int,end:int,score:double,ln_e:double>>"})
    return docs.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, model: Model, fold: int = FOLD, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_passages."""
    found = scan_toxicity(single(docs), model)
    return found.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), fold) == held_out).alias("held_out"),
        F.col(OWN + "score").alias("score"),
        (F.col(OWN + "score") >= threshold).cast("int").alias("predicted"),
        F.size(OWN + "passages").alias("n_passages"),
    )


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, unchanged."""
    return scan_toxicity(docs, model, docs.columns).filter(F.col(OWN + "score") < threshold).select(*docs.columns)
