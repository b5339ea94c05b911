"""Alignment of two tokenizers over the bytes of every text, by an associative fragment monoid.

*Groups.*  Both token sequences of a text cover the same bytes.  Offsets where tokens of A and of B both end cut
them into groups, the smallest runs that hold the same bytes.  Two tokens are linked when their byte ranges overlap;
between neighbouring ends of either sequence there is exactly one link.
*Fragments.*  What is known of a byte range: an open prefix (tokens up to the first common end), closed groups, and an open
suffix (tokens after the last common end); without a common end all of it is one open run.  Composing two neighbours
closes one group, suffix plus prefix, or lengthens an open run; it is associative and the empty fragment is neutral,
so ranges can be worked on in any grouping.
*Very long texts.*  A text of more than ``CHUNK_BYTES`` is dealt as byte ranges to tasks of their own.  Closed groups stay where they
were found; only the open ends go through a reduction tree, ``FAN`` neighbours a round, each round a written table.
*Counts.*  Links are added up by id pair, per task first.  Up to ``MAX_PAIRS`` pairs are broadcast to the documents; beyond that
documents' distinct pairs join them by key, very frequent pairs by broadcast.

Texts are tokenised once.  Stored are a document's distinct pairs with multiplicities, not its tokens.  Null and empty
texts, and texts whose joined token bytes differ from the text behind one space, have no tokens: zeros and an empty digest.  Rows
repeat as they are and each counts.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pictorium.plans.scratch import Scratch
from pictorium.plans.skew import HOT_ROWS, lookup_join

from .common import OWN, row_batches, texts

CHUNK_BYTES = 1 << 16
FAN = 16
MAX_PAIRS = 2_000_000
#: Bits of a token id in a pair's key.
ID_BITS = 20
_MASK = (1 << ID_BITS) - 1


class Coder(NamedTuple):
    """One tokenizer: ids of a text, and the bytes of every id."""

    encode: object
    pieces: list[bytes]
    lengths: np.ndarray


_coders: dict[tuple, tuple[Coder, Coder]] = {}


def coders(path_a: str | None = None, path_b: str | None = None) -> tuple[Coder, Coder]:
    """Byte-level BPE in rank form (A) and piece BPE with byte fallback (B); once per worker."""
    key = (path_a, path_b)
    if key not in _coders:
        import public_tokenizers

        a = _byte_bpe(path_a or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        _coders[key] = (a, _piece_bpe(path_b or public_tokenizers.path("piece_bpe_32k.model")))
    return _coders[key]


def _byte_bpe(path: str) -> Coder:
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    exact: list = []

    def encode(text: str) -> np.ndarray:
        try:
            return bpe.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # a run of about a million blanks; the JSON form has no such limit
            if not exact:
                from tokenizers import Tokenizer

                exact.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
                exact[0].encode_special_tokens = True
            return np.array(exact[0].encode(text, add_special_tokens=False).ids)

    return Coder(encode, pieces, np.array([len(x) for x in pieces]))


def _piece_bpe(path: str) -> Coder:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in ids]
    return Coder(lambda text: np.array(model.encode(text, num_threads=1), np.int64), pieces, np.array([len(x) for x in pieces]))


def tokens(text: str, pair: tuple[Coder, Coder]) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids of both tokenizers, or None where they don't cover the text."""
    if not text:
        return None
    a, b = pair
    raw = b" " + text.encode("utf-8", "surrogatepass")
    try:
        ids_a, ids_b = a.encode(" " + text), b.encode(text)
    except UnicodeEncodeError:
        return None
    for coder, ids in ((a, ids_a), (b, ids_b)):
        if b"".join(map(coder.pieces.__getitem__, ids.tolist())) != raw:
            return None
    return ids_a.astype(np.int64), ids_b.astype(np.int64)


class Run(NamedTuple):
    """Neighbouring tokens of both sequences and the byte offsets at which the first of each starts."""

    a: np.ndarray
    b: np.ndarray
    at_a: int
    at_b: int

    def then(self, other: Run) -> Run:
        return Run(
            np.concatenate([self.a, other.a]),
            np.concatenate([self.b, other.b]),
            self.at_a if len(self.a) else other.at_a,
            self.at_b if len(self.b) else other.at_b,
        )


_NONE = np.zeros(0, np.int64)
EMPTY = Run(_NONE, _NONE, 0, 0)


class Fragment(NamedTuple):
    """Open prefix, closed runs in order, open suffix; ``right`` is None without a common end."""

    left: Run = EMPTY
    closed: tuple[Run, ...] = ()
    right: Run | None = None


def fragment(run: Run, len_a: np.ndarray, len_b: np.ndarray, first: bool) -> Fragment:
    """Of the tokens that end in one byte range; before the first range of a text there is a common end."""
    ends_a, ends_b = run.at_a + np.cumsum(len_a[run.a]), run.at_b + np.cumsum(len_b[run.b])
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    if first:
        common = np.concatenate([[0], common])
    if not len(common):
        return Fragment(run)
    a0, a1 = np.searchsorted(ends_a, common[[0, -1]], "right")
    b0, b1 = np.searchsorted(ends_b, common[[0, -1]], "right")
    start, stop = int(common[0]), int(common[-1])
    inner = Run(run.a[a0:a1], run.b[b0:b1], start, start)
    return Fragment(Run(run.a[:a0], run.b[:b0], run.at_a, run.at_b), (inner,) if len(inner.a) else (), Run(run.a[a1:], run.b[b1:], stop, stop))


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of both ranges, ``y`` behind ``x``."""
    if x.right is None:
        return Fragment(x.left.then(y.left), y.closed, y.right)
    met = x.right.then(y.left)
    if y.right is None:
        return Fragment(x.left, x.closed, met)
    return Fragment(x.left, x.closed + ((met,) if len(met.a) else ()) + y.closed, y.right)


class Aligned(NamedTuple):
    """Closed runs of one batch: per run its sizes, its groups as text, its distinct pairs with multiplicities."""

    n_a: np.ndarray
    n_b: np.ndarray
    groups: np.ndarray
    links: np.ndarray
    text: list[bytes]
    ends: np.ndarray
    pair_a: np.ndarray
    pair_b: np.ndarray
    times: np.ndarray


_separated: dict[tuple[int, int], list[bytes]] = {}


def _names(n_a: int, n_b: int) -> list[bytes]:
    """Decimal ids with the separator behind them: of A ``,`` or ``|``, of B ``,`` or ``;``."""
    if (n_a, n_b) not in _separated:
        _separated[n_a, n_b] = [b"%d%s" % (i, s) for i in range(n_a) for s in (b",", b"|")] + [b"%d%s" % (i, s) for i in range(n_b) for s in (b",", b";")]
    return _separated[n_a, n_b]


def align(runs: list[tuple[np.ndarray, np.ndarray]], len_a: np.ndarray, len_b: np.ndarray) -> Aligned:
    """Groups and links of runs (ids of A, ids of B) that cover equal bytes each, none empty."""
    if not runs:
        return Aligned(_NONE, _NONE, _NONE, _NONE, [], _NONE, _NONE, _NONE, _NONE)
    n_a, n_b = np.array([len(r[0]) for r in runs]), np.array([len(r[1]) for r in runs])
    a, b = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    ends_a, ends_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    last = ends_a[np.cumsum(n_a) - 1]  # end of every run
    at_a, at_b = np.zeros(last[-1] + 1, bool), np.zeros(last[-1] + 1, bool)
    at_a[ends_a] = True
    at_b[ends_b] = True
    ends = np.flatnonzero(at_a | at_b)  # one link before each
    in_a, in_b = np.cumsum(at_a[ends]), np.cumsum(at_b[ends])
    link_a, link_b = in_a - at_a[ends], in_b - at_b[ends]
    both = at_a[ends] & at_b[ends]
    closes = np.flatnonzero(both)
    run_of = np.repeat(np.arange(len(runs)), np.diff(np.searchsorted(ends, last, "right"), prepend=0))
    groups = np.bincount(run_of[closes], minlength=len(runs))
    links = np.bincount(run_of, minlength=len(runs))
    # distinct pairs of every run
    key = np.sort((run_of.astype(np.int64) << 2 * ID_BITS) | (a[link_a] << ID_BITS) | b[link_b])
    new = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(np.append(new, len(key)))
    key = key[new]
    # tokens in the order of the groups' text
    cum_a, cum_b = in_a[closes], in_b[closes]  # tokens up to every common end
    shut_a, shut_b = at_b[ends_a], at_a[ends_b]
    group_a, group_b = np.cumsum(shut_a) - shut_a, np.cumsum(shut_b) - shut_b
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + np.concatenate([[0], cum_b])[group_a]] = 2 * a + shut_a
    code[np.arange(len(b)) + cum_a[group_b]] = 2 * (len(len_a) + b) + shut_b
    names = _names(len(len_a), len(len_b))
    stops = np.cumsum(n_a + n_b)
    parts = [b"".join(map(names.__getitem__, code[s - n : s].tolist()))[:-1] for s, n in zip(stops, n_a + n_b)]
    ends_of_pairs = np.searchsorted(key >> 2 * ID_BITS, np.arange(len(runs)), "right")
    return Aligned(n_a, n_b, groups, links, parts, ends_of_pairs, (key >> ID_BITS) & _MASK, key & _MASK, times)


_CLOSED = "row long, doc_id {id}, long boolean, pos int, n_a long, n_b long, n_groups long, n_links long, digest string, body binary, pa array<int>, pb array<int>, pm array<int>"
_RUN = "at_a long, at_b long, a array<int>, b array<int>"
_CHUNK = "part int, parts int, " + _RUN


def _int_lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values.astype(np.int32)))


def _closed_columns(found: Aligned, digests: bool) -> dict[str, pa.Array]:
    n = len(found.text)
    nothing = pa.nulls(n)
    return {
        "n_a": pa.array(found.n_a, pa.int64()),
        "n_b": pa.array(found.n_b, pa.int64()),
        "n_groups": pa.array(found.groups, pa.int64()),
        "n_links": pa.array(found.links, pa.int64()),
        "digest": pa.array([hashlib.sha256(t).hexdigest() for t in found.text], pa.string()) if digests else nothing.cast(pa.string()),
        "body": nothing.cast(pa.binary()) if digests else pa.array(found.text, pa.binary()),
        "pa": _int_lists(found.pair_a, found.ends),
        "pb": _int_lists(found.pair_b, found.ends),
        "pm": _int_lists(found.times, found.ends),
    }


def _nulls(n: int, names: list[str], schema: pa.Schema) -> dict[str, pa.Array]:
    return {name: pa.nulls(n, schema.field(name).type) for name in names}


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


class _Aligner:
    def __init__(self, scratch: Scratch, chunk_bytes: int, fan: int, max_pairs: int, hot_rows: int, paths: tuple):
        self.scratch, self.chunk_bytes, self.fan, self.max_pairs, self.hot_rows, self.paths = scratch, chunk_bytes, fan, max_pairs, hot_rows, paths

    def first_step(self, docs: DataFrame) -> DataFrame:
        """Every text tokenised once.  Short texts come out finished, long ones as byte ranges (``part`` of ``parts``)."""
        kind = docs.schema["doc_id"].dataType.simpleString()
        ddl = _CLOSED.format(id=kind) + ", " + _CHUNK
        docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        limit, paths, schema = self.chunk_bytes, self.paths, _arrow_schema(ddl)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair = coders(*paths)
            for batch in row_batches(batches, 1 << 20):
                short, runs, without, chunks = [], [], [], []
                for i, text in enumerate(texts(batch)):
                    found = tokens(text, pair)
                    if found is None:
                        without.append(i)
                    elif len(text) > limit or int(pair[0].lengths[found[0]].sum()) > limit:
                        chunks += [(i, *c) for c in byte_ranges(*found, pair[0].lengths, pair[1].lengths, limit)]
                    else:
                        short.append(i)
                        runs.append(found)
                out = []
                if short:
                    new = _closed_columns(align(runs, pair[0].lengths, pair[1].lengths), True)
                    out.append((short, new | {"long": pa.array([False] * len(short)), "pos": pa.array([0] * len(short), pa.int32())}))
                if without:
                    zeros = pa.array([0] * len(without), pa.int64())
                    new = {c: zeros for c in ("n_a", "n_b", "n_groups", "n_links")}
                    empty = pa.array([[]] * len(without), pa.list_(pa.int32()))
                    new |= {"digest": pa.array([""] * len(without)), "pa": empty, "pb": empty, "pm": empty, "long": pa.array([False] * len(without))}
                    out.append((without, new))
                for i, part, parts, piece in chunks:
                    new = {"long": pa.array([True]), "part": pa.array([part], pa.int32()), "parts": pa.array([parts], pa.int32())}
                    out.append(([i], new | {k: pa.array([v]) for k, v in _run_columns(piece).items()}))
                for rows, new in out:
                    new |= {"row": batch.column("row").take(pa.array(rows)), "doc_id": batch.column("doc_id").take(pa.array(rows))}
                    new |= _nulls(len(rows), [f for f in schema.names if f not in new], schema)
                    yield pa.RecordBatch.from_arrays([new[f].cast(schema.field(f).type) for f in schema.names], names=schema.names)

        return docs.mapInArrow(run, ddl)

    def fragments(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Closed runs and open ends of byte ranges, each range a row that any task may get."""
        kind = chunks.schema["doc_id"].dataType.simpleString()
        paths = self.paths

        def run(frame):
            pair = coders(*paths)
            for rows in frame:
                for r in rows.itertuples():
                    piece = Run(np.asarray(r.a, np.int64), np.asarray(r.b, np.int64), r.at_a, r.at_b)
                    yield _reduced([(r.part, fragment(piece, pair[0].lengths, pair[1].lengths, r.part == 0))], r.row, r.doc_id, r.part, pair)

        ranges = chunks.repartition("row", "part").select("row", "doc_id", "part", "at_a", "at_b", "a", "b")
        return self._split(ranges.mapInPandas(run, _tree_ddl(kind)))

    def reduce(self, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One round of the tree: ``fan`` neighbouring ranges become one."""
        kind = ends.schema["doc_id"].dataType.simpleString()
        paths, fan = self.paths, self.fan

        def run(rows):
            pair = coders(*paths)
            rows = rows.sort_values("part")
            parts = [(r.right_part, _fragment_of(r)) for r in rows.itertuples()]
            return _reduced(parts, rows["row"].iloc[0], rows["doc_id"].iloc[0], int(rows["part"].iloc[0]) // fan, pair)

        node = F.floor(F.col("part") / fan)
        return self._split(ends.groupBy("row", node.alias(OWN + "node")).applyInPandas(run, _tree_ddl(kind)))

    def _split(self, made: DataFrame) -> tuple[DataFrame, DataFrame]:
        made, _ = self.scratch.write(made)
        closed = made.filter("not is_open").select("row", "doc_id", F.lit(True).alias("long"), "pos", "n_a", "n_b", "n_groups", "n_links", F.lit(None).cast("string").alias("digest"), "body", "pa", "pb", "pm")
        return closed, made.filter("is_open").select("row", "doc_id", *_OPEN)

    def closed_runs(self, docs: DataFrame) -> DataFrame:
        """All closed runs; a short text is one."""
        first, seen = self.scratch.write(self.first_step(docs), parts=F.coalesce(F.max("parts"), F.lit(0)))
        closed = first.filter(F.col("part").isNull()).drop("part", "parts", "at_a", "at_b", "a", "b")
        if not seen["parts"]:
            return closed
        more, ends = self.fragments(first.filter(F.col("part").isNotNull()))
        closed, left = closed.unionByName(more), seen["parts"]
        while left > 1:
            more, ends = self.reduce(ends)
            closed, left = closed.unionByName(more), -(-left // self.fan)
        return closed

    def pairs(self, closed: DataFrame) -> tuple[DataFrame, dict]:
        """(key, n, best): links by id pair over all rows, and whether no other A id has more links with the pair's B id."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, n = _NONE, _NONE
            for batch in batches:
                k, m = _keys(batch.column("pa"), batch.column("pb")), _flat(batch.column("pm"))
                key, n = np.concatenate([key, k]), np.concatenate([n, m])
                if len(key) > 3_000_000:
                    key, n = _added(key, n)
                    if len(key) > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])
                        key, n = _NONE, _NONE
            key, n = _added(key, n)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

        counted, _ = self.scratch.write(closed.select("pa", "pb", "pm").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
        of_b = F.col("key").bitwiseAND(_MASK)
        most = counted.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))  # one row per id of B: bounded by its vocabulary
        rated = counted.withColumn("b", of_b).join(F.broadcast(most), "b").select("key", "n", (F.col("n") == F.col("most")).alias("best"))
        return self.scratch.write(rated, k=F.count(F.lit(1)), links=F.coalesce(F.sum("n"), F.lit(0)))

    def scored(self, closed: DataFrame, pairs: DataFrame, seen: dict) -> DataFrame:
        """Closed runs with n_best and count_sum in place of their pairs."""
        rest = [c for c in closed.columns if c not in ("pa", "pb", "pm")]
        if seen["k"] > self.max_pairs:
            return self._joined(closed, rest, pairs, seen)
        table = pairs.orderBy("key").toArrow()
        columns = [table.column(c).to_numpy() for c in ("key", "n", "best")]
        shared = closed.sparkSession.sparkContext.broadcast(columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, n, best = shared.value
            for batch in row_batches(batches):
                m = _flat(batch.column("pm"))
                at = np.searchsorted(key, _keys(batch.column("pa"), batch.column("pb")))
                row = np.repeat(np.arange(batch.num_rows), batch.column("pm").value_lengths().fill_null(0).to_numpy())
                sums = []
                for values in (m * best[at], m * n[at]):
                    total = np.zeros(batch.num_rows, np.int64)
                    np.add.at(total, row, values)
                    sums.append(pa.array(total))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + sums, names=rest + ["n_best", "count_sum"])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in closed.schema if f.name in rest)
        return closed.mapInArrow(run, fields + ", n_best long, count_sum long")

    def _joined(self, closed: DataFrame, rest: list[str], pairs: DataFrame, seen: dict) -> DataFrame:
        """The same for any number of pairs, by joins."""
        links = closed.select("row", "pos", F.explode(F.arrays_zip("pa", "pb", "pm")).alias("p"))
        key = F.shiftleft(F.col("p.pa").cast("long"), ID_BITS).bitwiseOR(F.col("p.pb").cast("long"))
        links = links.select("row", "pos", key.alias("key"), F.col("p.pm").cast("long").alias("m"))
        met = lookup_join(links, pairs, ["key"], seen["links"], self.hot_rows, pairs.select("key", "n"))
        sums = met.groupBy("row", "pos").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
        zero = F.lit(0).cast("long")
        both = closed.select(*rest).join(sums, ["row", "pos"], "left")
        return both.select(*rest, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


_SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_SIDE = ["at_a", "at_b", "a", "b"]
_OPEN = ["part", "cut", "right_part", *["left_" + c for c in _SIDE], *["right_" + c for c in _SIDE]]


def _tree_ddl(kind: str) -> str:
    sides = ", ".join(f"{side}_{field.strip()}" for side in ("left", "right") for field in _RUN.split(","))
    closed = "pos int, n_a long, n_b long, n_groups long, n_links long, body binary, pa array<int>, pb array<int>, pm array<int>"
    return f"row long, doc_id {kind}, is_open boolean, part int, cut boolean, right_part int, {sides}, {closed}"


def _run_columns(r: Run, prefix: str = "") -> dict:
    return {prefix + "at_a": r.at_a, prefix + "at_b": r.at_b, prefix + "a": r.a.astype(np.int32), prefix + "b": r.b.astype(np.int32)}


def _fragment_of(r) -> Fragment:
    sides = [Run(np.asarray(getattr(r, s + "_a"), np.int64), np.asarray(getattr(r, s + "_b"), np.int64), getattr(r, s + "_at_a"), getattr(r, s + "_at_b")) for s in ("left", "right")]
    return Fragment(sides[0], (), sides[1] if r.cut else None)


def _reduced(parts: list[tuple[int, Fragment]], row: int, doc_id, node: int, pair: tuple[Coder, Coder]):
    """Composes neighbouring fragments.  Gives one row with the open ends and a row for every closed run, in the order of ``pos``:
    even for a range's own groups, odd for the group that the suffix of the range before it opens."""
    import pandas as pd

    whole, at = parts[0][1], parts[0][0]
    closed = [(2 * at, run) for run in whole.closed]
    for right_part, nxt in parts[1:]:
        done = len(whole.closed)
        met = compose(whole, nxt)
        opened = whole.right is not None and nxt.right is not None and len(met.closed) - done - len(nxt.closed) == 1
        if opened:
            closed.append((2 * at + 1, met.closed[done]))
        closed += [(2 * right_part, run) for run in nxt.closed]
        if nxt.right is not None:
            at = right_part
        whole = met
    found = align([(run.a, run.b) for _, run in closed], pair[0].lengths, pair[1].lengths)
    starts = np.concatenate([[0], found.ends]).astype(int)
    right = EMPTY if whole.right is None else whole.right
    rows = [{"is_open": True, "part": node, "cut": whole.right is not None, "right_part": at, **_run_columns(whole.left, "left_"), **_run_columns(right, "right_")}]
    for k, (pos, _) in enumerate(closed):
        own = slice(starts[k], starts[k + 1])
        sizes = {"n_a": found.n_a[k], "n_b": found.n_b[k], "n_groups": found.groups[k], "n_links": found.links[k]}
        rows.append({"is_open": False, "pos": pos, "body": found.text[k], **sizes, "pa": found.pair_a[own], "pb": found.pair_b[own], "pm": found.times[own]})
    names = [x.split()[0] for x in _tree_ddl("long").split(", ")]
    table = {n: [r.get(n) for r in rows] for n in names} | {"row": [row] * len(rows), "doc_id": [doc_id] * len(rows)}
    return pd.DataFrame(table, dtype=object)[names]


def byte_ranges(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray, limit: int) -> list[tuple[int, int, Run]]:
    """(part, parts, run) of a text: part k has the tokens that end in bytes (k * limit, (k + 1) * limit]."""
    ends_a, ends_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    parts = -(-int(ends_a[-1]) // limit)
    stops = np.arange(1, parts + 1) * limit
    cut_a = np.concatenate([[0], np.searchsorted(ends_a, stops, "right")])
    cut_b = np.concatenate([[0], np.searchsorted(ends_b, stops, "right")])
    at = lambda ends, i: int(ends[i - 1]) if i else 0
    return [
        (k, parts, Run(a[cut_a[k] : cut_a[k + 1]], b[cut_b[k] : cut_b[k + 1]], at(ends_a, cut_a[k]), at(ends_b, cut_b[k])))
        for k in range(parts)
    ]


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _keys(a: pa.Array, b: pa.Array) -> np.ndarray:
    return (_flat(a) << ID_BITS) | _flat(b)


def _added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers added up by key."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    return key[new], np.add.reduceat(n, new) if len(new) else n


def _long_digests(closed: DataFrame) -> DataFrame:
    """(row, digest) of texts in several closed runs: their groups are hashed in order as a stream, so a task holds one run at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, state = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for r, body in zip(batch.column("row").to_pylist(), batch.column("body")):
                if r != row:
                    if state is not None:
                        done.append((row, state.hexdigest()))
                    row, state = r, hashlib.sha256()
                else:
                    state.update(b";")
                state.update(body.as_buffer())
            yield _digest_rows(done)
        yield _digest_rows([(row, state.hexdigest())] if state is not None else [])

    ordered = closed.select("row", "pos", "body").repartition("row").sortWithinPartitions("row", "pos")
    return ordered.mapInArrow(run, "row long, digest string")


def _digest_rows(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.string())], names=["row", "digest"])


def align_tokenizers(
    docs: DataFrame,
    chunk_bytes: int = CHUNK_BYTES,
    fan: int = FAN,
    max_pairs: int = MAX_PAIRS,
    hot_rows: int = HOT_ROWS,
    path_a: str | None = None,
    path_b: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Documents and id pairs.

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its B id), count_sum (of the links'
    pair counts), groups_sha256.  Pairs: a, b, n (links over all documents) and best."""
    scratch = Scratch(docs.sparkSession, "align")
    work = _Aligner(scratch, chunk_bytes, fan, max_pairs, hot_rows, (path_a, path_b))
    closed = work.closed_runs(docs)
    pairs, seen = work.pairs(closed)
    names = ["doc_id", *_SUMS, "groups_sha256"]
    short = work.scored(closed.filter("not long").drop("body"), pairs, seen).withColumnRenamed("digest", "groups_sha256").select(*names)
    long = closed.filter("long")
    sums = work.scored(long.drop("digest", "body"), pairs, seen).groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in _SUMS])
    found = sums.join(_long_digests(long), "row").withColumnRenamed("digest", "groups_sha256").select(*names)
    table = pairs.select(F.shiftright("key", ID_BITS).cast("int").alias("a"), F.col("key").bitwiseAND(_MASK).cast("int").alias("b"), "n", "best")
    return short.unionByName(found), table
