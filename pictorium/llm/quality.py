"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

*Statistics.*  A text becomes some thirty numbers (``statistics``): lengths, shares of letters,
digits, capitals, symbols and separators, repetition of lines and words, word
shapes.  Words, labels, language and source are no inputs.  *Features.*  ``cos(W z + b)`` with Gaussian ``W``
approximates a Gaussian kernel over the standardised statistics.  *Fit.*  Every task adds up its own normal
equations; the sums are added on the driver and solved once.  *Calibration.*  Isotonic regression on
rows that the ridge fit did not see.

The fit uses a bounded, documented sample of labelled rows (``SAMPLE_ROWS``); its statistics go to
``PARTS`` tasks, so at most ``PARTS`` sums of ``features ** 2`` numbers reach the driver.  Scoring
is map-only over all documents.

Null counts as empty; empty texts are scored like any other (all statistics 0).  Rows repeat as they
are.  Without labelled rows of both kinds the score is their share of ones (0.5 without any).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import isotonic
from .common import crc_mod, row_batches, schema_plus, single, texts, with_columns
from .sampling import SAMPLE_ROWS, labelled_sample

FEATURES = 256
PARTS = 8
RIDGE = 1e-3
FOLD, HELD_OUT, THRESHOLD = 5, 0, 0.3

_BYTE_CLASSES = np.zeros(256, np.int64)
for _i, _group in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"|", b"#$%&*@^~<>{}[]\\=_+/", b"\"'()-"), 1):
    _BYTE_CLASSES[list(_group)] = _i
_BYTE_CLASSES[128:] = 11
_N_CLASSES = 12
_SENTENCE_END = re.compile(rb"[.!?](?:\s|$)")


def statistics(text: str) -> list[float]:
    """Numbers that describe the form of a text."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * N_STATISTICS
    shares = np.bincount(_BYTE_CLASSES[np.frombuffer(data, np.uint8)], minlength=_N_CLASSES) / n
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_words, n_lines = max(len(words), 1), max(len(lines), 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    line_sizes: dict[bytes, int] = {}
    repeated = 0
    for x in lines:
        repeated += len(x) if x in line_sizes else 0
        line_sizes[x] = 1
    distinct = max(len(seen), 1)
    top = sorted(seen.values(), reverse=True)[:10]
    odd_end = sum(1 for w in words if not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in b".,"))
    caps = sum(1 for w in words if w[:1].isupper())
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    sentences = max(len(_SENTENCE_END.findall(data)), 1)
    return [
        math.log1p(n),
        math.log1p(len(words)),
        math.log1p(len(lines)),
        *shares[:_N_CLASSES].tolist(),
        float(sizes.mean()),
        float(sizes.std()),
        math.log1p(float(sizes.max())),
        distinct / n_words,
        math.log(distinct) / math.log(n_words + 1),
        (top[0] if top else 0) / n_words,
        sum(top) / n_words,
        sum(1 for c in seen.values() if c == 1) / distinct,
        repeated / n,
        1 - len(line_sizes) / n_lines if lines else 0.0,
        odd_end / n_words,
        caps / n_words,
        upper / n_words,
        math.log1p(n_words / sentences),
        math.log1p(n_words / n_lines),
        float((sizes <= 2).mean()),
        float((sizes >= 12).mean()),
    ]


N_STATISTICS = 32


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    constant: float | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        rff = np.cos(z @ self.w + self.b) * math.sqrt(2 / self.w.shape[1])
        return np.column_stack([rff, z, np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and ``stats`` (array of doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            yield with_columns(batch, keep, stats=pa.array([statistics(t) for t in texts(batch)], pa.list_(pa.float64())))

    return docs.mapInArrow(run, schema_plus(docs, keep, stats="array<double>"))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", fold: int = FOLD, held_out: int = HELD_OUT, features: int = FEATURES, most: int = SAMPLE_ROWS, seed: int = 7) -> Model:
    """Fit on labelled rows outside the held-out fold."""
    from pictorium.plans.scratch import materialize

    sample = labelled_sample(docs, labels, target, fold, held_out, most)
    rows = text_statistics(sample, ["doc_id", "y"]).withColumn("part", F.abs(F.xxhash64("doc_id")) % 4)
    rows = materialize(rows.repartition(PARTS), "quality-sample")
    sums = [F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(N_STATISTICS)] + [F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(N_STATISTICS)]
    got = rows.agg(*sums, F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).head()
    rng = np.random.default_rng(seed)
    # kernel width: squared distances of standardised rows are about twice their number of columns
    w = rng.normal(size=(N_STATISTICS, features)) / math.sqrt(N_STATISTICS)
    b = rng.uniform(0, 2 * math.pi, features)
    empty = np.zeros(0)
    if not got["n"] or got["y"] in (0.0, 1.0):
        return Model(empty, empty, w, b, empty, empty, empty, 0.5 if got["y"] is None else got["y"])
    mean = np.array([got[f"m{i}"] for i in range(N_STATISTICS)])
    scale = np.array([got[f"s{i}"] for i in range(N_STATISTICS)]) + 1e-6
    start = Model(mean, scale, w, b, empty, empty, empty)

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = features + N_STATISTICS + 1
        a, c = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = start.features(np.array(batch.column("stats").to_pylist()))
                a += x.T @ x
                c += x.T @ np.array(batch.column("y").to_pylist(), float)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], names=["a", "c"])

    parts = rows.filter("part > 0").coalesce(PARTS).mapInArrow(normal_equations, "a binary, c binary").collect()
    size = features + N_STATISTICS + 1
    a = sum((np.frombuffer(p["a"]).reshape(size, size) for p in parts), np.zeros((size, size)))
    c = sum((np.frombuffer(p["c"]) for p in parts), np.zeros(size))
    beta = np.linalg.solve(a + RIDGE * max(a[-1, -1], 1) * np.eye(size), c)
    fitted = start._replace(beta=beta)
    own = rows.filter("part = 0").select("stats", "y").toPandas()  # a part of the bounded sample
    if not len(own):
        return fitted._replace(constant=got["y"])
    knots, values = isotonic(fitted.raw(np.array(own["stats"].tolist())), own["y"].to_numpy())
    return fitted._replace(knots=knots, values=values)


def score_quality(docs: DataFrame, model: Model, fold: int = FOLD, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = single(docs)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*shared.value)
        for batch in row_batches(batches):
            stats = np.array([statistics(t) for t in texts(batch)]).reshape(-1, N_STATISTICS)
            yield with_columns(batch, ["doc_id"], score=pa.array(fitted.score(stats), pa.float64()))

    scored = docs.mapInArrow(run, schema_plus(docs, ["doc_id"], score="double"))
    return scored.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), fold) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
