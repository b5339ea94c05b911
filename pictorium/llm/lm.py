"""Log-likelihood of whole documents under a gated recurrent language model.

*Counts.*  All tokens of all training documents are counted (tasks add up first).  Words with the highest counts, at
most ``HOT_WORDS``, are broadcast with their counts; where to cut is read off a histogram of the counts.
*Model.*  ``CLASSES * MEMBERS`` most frequent tokens are symbols of a GRU with
class-factored softmax (:mod:`.gru`); every other word is one of ``MEMBERS`` rest symbols, by the
form of the word, and has there the probability ``(c + 1) / Z``, Z being the sum over that group's words
plus one for unseen ones.  So all probabilities add up to one.
*Training.*  Every task runs truncated backpropagation through its own training documents from common
start values (biases that give the token frequencies); the state runs through whole documents, gradients
are taken in every window of every training document (``STRIDE`` 1).  The parameters of all tasks are averaged by tokens,
in groups of bounded size (parameter mixing).  All training documents take part, so what is gathered
grows with the input.
*Scoring.*  The state is carried across windows through the whole document.  Words outside the broadcast
ones meet their counts in one join (a word per document and row).

Null counts as empty: its only token is the end.  Rows repeat as they are.  Without training
documents the base score is 0 and the model is the untrained one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pictorium.plans.scratch import Scratch

from .common import OWN, crc_mod, row_batches, schema_plus, with_columns
from .gru import Gru, Trainer, flatten, restore, start_parameters

FOLD, HELD_OUT = 7, 2
HOT_WORDS = 65_536
CLASSES, MEMBERS = 64, 64
STATE, INPUTS = 16, 16
STRIDE = 1
RATE = 0.15
CHUNKS = 16
END = b""


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, A-Z lower-cased, then the end, of one text after another, and where each text's end: null is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.values.cast(pa.binary())
    full = pc.binary_length(words).to_numpy() > 0  # white space at the ends of a text leaves empty parts
    before = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy()]
    ends = before[1:] + np.arange(1, len(lists) + 1)
    take = np.empty(len(lists) + int(before[-1]), np.int64)
    is_word = np.ones(len(take), bool)
    is_word[ends - 1] = False
    take[is_word] = np.flatnonzero(full)
    take[~is_word] = len(words)
    return pa.concat_arrays([words, pa.array([END], pa.binary())]).take(pa.array(take)), ends


def rest_groups(words: pa.Array) -> np.ndarray:
    """Forms of words: the first byte and whether there are non-ASCII characters."""
    words = pa.concat_arrays([words])  # from offset 0
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32, len(words) + 1) if len(words) else np.zeros(1, np.int32)
    body = np.frombuffer(data, np.uint8) if data is not None and at[-1] else np.zeros(1, np.uint8)
    wide = np.concatenate([[0], np.cumsum(body[: at[-1]] > 127)])[at]
    first = body[np.minimum(at[:-1], len(body) - 1)].astype(np.int64)
    return np.where(at[1:] > at[:-1], ((first & 31) * 2 + (np.diff(wide) > 0)) % MEMBERS, 0)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def added_up(parts):
            return pa.concat_tables(parts).group_by("word").aggregate([("c", "sum")]).rename_columns({"c_sum": "c"}).select(["word", "c"])

        parts, rows = [], 0
        for batch in row_batches(batches):
            counts = pc.value_counts(tokens(batch.column("text"))[0])
            parts.append(pa.table({"word": counts.field("values"), "c": counts.field("counts")}))
            rows += len(counts)
            if rows > 2_000_000:
                parts = [added_up(parts)]
                rows = parts[0].num_rows
                if rows > 1_000_000:
                    yield from parts[0].to_batches()
                    parts, rows = [], 0
        if rows:
            yield from added_up(parts).to_batches()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The broadcast words: position, symbol, and what scoring adds for them."""

    def __init__(self, hot: list[tuple[bytes, int]], z: np.ndarray):
        n = min(len(hot), CLASSES * MEMBERS)
        self.words = pa.array([w for w, _ in hot], pa.binary())
        groups = rest_groups(self.words)
        self.symbol = np.where(np.arange(len(hot)) < n, np.arange(len(hot)), CLASSES * MEMBERS + groups).astype(np.int32)
        self.log_c = np.array([math.log10(c + 1) for _, c in hot])
        self.log_z = np.log10(z)
        self.within = np.where(np.arange(len(hot)) < n, 0.0, self.log_c - self.log_z[groups])

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Positions among the broadcast words (-1 for others) and symbols."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        symbols, other = np.empty(len(at), np.int32), at < 0
        symbols[~other] = self.symbol[at[~other]]
        symbols[other] = CLASSES * MEMBERS + rest_groups(words.filter(pa.array(other)))
        return at, symbols


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` words, by falling count: all above a count read off a histogram."""
    level = F.floor(F.log2("c") * 32)
    seen = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    cut, total = None, 0
    for at, n in seen:
        total += n
        if total > most:
            break
        cut = at
    if cut is None:
        return []
    rows = counts.filter(level >= cut).collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


def _rest_sums(counts: DataFrame, known: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per rest group: sum of c + 1 and sum of c over the words that are no symbol."""
    shared = counts.sparkSession.sparkContext.broadcast(pa.array(known, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, MEMBERS))
        for batch in batches:
            rest = batch.filter(pc.invert(pc.is_in(batch.column("word"), value_set=shared.value)))
            groups, c = rest_groups(rest.column("word")), rest.column("c").to_numpy()
            out += [np.bincount(groups, weights=x, minlength=MEMBERS) for x in (c + 1, c)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(MEMBERS)), pa.array(out[0]), pa.array(out[1])], names=["g", "more", "c"])

    sums = counts.mapInArrow(run, "g long, more double, c double").groupBy("g").agg(F.sum("more").alias("more"), F.sum("c").alias("c")).collect()
    z, c = np.ones(MEMBERS), np.zeros(MEMBERS)
    for r in sums:
        z[r["g"]] += r["more"]
        c[r["g"]] = r["c"]
    return z, c


def train(docs: DataFrame, start: dict[str, np.ndarray], hot: list[tuple[bytes, int]], z: np.ndarray, stride: int = STRIDE, rate: float = RATE) -> dict[str, np.ndarray]:
    """Parameters averaged over the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast((start, hot, z))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, words, sums = shared.value
        vocabulary, trainer = Vocabulary(words, sums), Trainer(first, rate)
        for k, batch in enumerate(row_batches(batches, 16 << 20)):
            words, ends = tokens(batch.column("text"))
            trainer.train(np.split(vocabulary.encode(words)[1], ends[:-1]), stride, k)
        if trainer.tokens:
            parts = np.array_split(flatten(trainer.net.p).astype(np.float64) * trainer.tokens, CHUNKS)
            pid = TaskContext.get().partitionId()
            arrays = [pa.array(range(CHUNKS), pa.int32()), pa.array([pid] * CHUNKS, pa.int64()), pa.array([float(trainer.tokens)] * CHUNKS), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["chunk", "part", "weight", "sums"])

    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(x, np.float32).astype(np.float64) for x in rows["sums"]), 0.0)
        return pd.DataFrame({"chunk": rows["chunk"][:1], "part": rows["part"][:1], "weight": [rows["weight"].sum()], "sums": [total.astype(np.float32).tobytes()]})

    schema = "chunk int, part long, weight double, sums binary"
    rows = docs.select("text").mapInArrow(run, schema)
    for groups in (4096, 64, 1):  # no group holds more than a 64th of the tasks at first, and 64 rows later
        rows = rows.groupBy("chunk", (F.col("part") % groups).alias("own")).applyInPandas(add_up, schema)
    got = sorted(rows.collect(), key=lambda r: r["chunk"])
    if not got:
        return start
    return restore(np.concatenate([np.frombuffer(r["sums"], np.float32) / r["weight"] for r in got]), start)


def score_documents(docs: DataFrame, fold: int = FOLD, held_out: int = HELD_OUT, hot_words: int = HOT_WORDS, stride: int = STRIDE) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (smoothed counts) and score (the model), both log10."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    out_of_fold = crc_mod(F.col("doc_id"), fold) == held_out
    docs = docs.select("doc_id", "text")
    training = docs.filter(~out_of_fold)
    counts, seen = scratch.write(count_tokens(training), n=F.sum("c"), v=F.count(F.lit(1)))
    n_train, distinct = seen["n"] or 0, seen["v"] or 0
    hot = _most_frequent(counts, hot_words)
    z, rest = _rest_sums(counts, [w for w, _ in hot[: CLASSES * MEMBERS]])
    symbols = np.zeros((CLASSES + 1) * MEMBERS)
    top = [c for _, c in hot[: CLASSES * MEMBERS]]
    symbols[: len(top)] = top
    symbols[CLASSES * MEMBERS :] = rest
    parameters = train(training, start_parameters(symbols, CLASSES + 1, MEMBERS, STATE, INPUTS), hot, z, stride)
    shared = spark.sparkContext.broadcast((parameters, hot, z))
    row = OWN + "row"
    names = {"n_tokens": "long", "hot_known": "long", "hot_log": "double", "model": "double", "words": "array<binary>", "times": "array<int>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, words, rest_sums = shared.value
        net, vocabulary = Gru(values), Vocabulary(words, rest_sums)
        for batch in row_batches(batches, 16 << 20):
            w, ends = tokens(batch.column("text"))
            at, ids = vocabulary.encode(w)
            n = np.diff(ends, prepend=0)
            doc = np.repeat(np.arange(len(n)), n)
            known, out = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)

            def sums(rows, weights=None):
                return np.bincount(doc[rows], weights=weights, minlength=len(n))

            extra = sums(known, vocabulary.within[at[known]]) - sums(out, vocabulary.log_z[ids[out] - CLASSES * MEMBERS])
            missing = w.take(pa.array(out)).dictionary_encode()
            distinct = max(len(missing.dictionary), 1)
            pairs, times = np.unique(doc[out] * distinct + missing.indices.to_numpy(), return_counts=True)
            starts = pa.array(np.searchsorted(pairs, np.arange(len(n) + 1) * distinct), pa.int32())
            others = pa.ListArray.from_arrays(starts, missing.dictionary.take(pa.array(pairs % distinct)))
            model = net.score(np.split(ids, ends[:-1])) / math.log(10) + extra
            log_c = sums(known, vocabulary.log_c[at[known]])
            cols = [pa.array(n, pa.int64()), pa.array(sums(known), pa.int64()), pa.array(log_c, pa.float64()), pa.array(model, pa.float64()), others, pa.ListArray.from_arrays(starts, pa.array(times, pa.int32()))]
            yield with_columns(batch, [row, "doc_id", "held_out"], **dict(zip(names, cols)))

    rows = docs.select(F.monotonically_increasing_id().alias(row), "doc_id", out_of_fold.alias("held_out"), "text")
    scored, _ = scratch.write(rows.mapInArrow(run, schema_plus(rows, [row, "doc_id", "held_out"], **names)))
    flat = scored.select(row, F.explode(F.arrays_zip("words", "times")).alias("x")).select(row, "x.words", "x.times")
    met = flat.join(counts, flat["words"] == counts["word"], "left")
    log_c = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)
    other = met.groupBy(row).agg(F.sum(log_c).alias("other_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("other_known"))
    both = scored.drop("words", "times").join(other, row, "left")
    more = F.coalesce("other_log", F.lit(0.0))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("other_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("hot_log") + more - F.col("n_tokens") * math.log10(n_train + distinct + 1)).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
