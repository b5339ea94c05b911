"""Near duplicates with ProbMinHash signatures, banding and exact verification.

*Shingles.*  Five consecutive words (all words of a shorter text), hashed; how often a shingle comes does
not count, as links are by the sets.  *ProbMinHash.*  Every shingle is a Poisson process of
its weight, here 1; an arrival goes to a random one of ``REGISTERS`` registers, which keep the
shingle of their earliest arrival.  A shingle stops as soon as its next arrival is later than all registers
of the text (early termination), so the work is about one arrival per shingle.  Two texts agree in a register
with their probability Jaccard similarity, which for equal weights is the Jaccard similarity of the sets.
*Nodes.*  Texts with one shingle set are one node (named by a 64-bit hash of the set), so copies
never meet in a bucket.  *Banding.*  Nodes that agree in all registers of a band share a
bucket.  First every node is compared with the bucket's smallest node only; verified links give
classes.  Members of one class need no link, so only the nodes of buckets that still hold several classes go on.
*Prefix join.*  These are joined exactly by their sets, without looking at all pairs of a bucket: shingles are ordered by the number of
these nodes that hold them, rare ones first.  The first shingle in this order that two sets have in common, at 0-based
positions p and q, leaves room for at most min(n - p, m - q) common ones, so only shingles near enough to the front of both sets can lead to a pair,
and a shingle of one node leads to none.  Alike texts below the threshold differ in rare shingles, which come first, so nearly all of
them end here.  A shingle with many nodes is cut into blocks of ``BLOCK`` nodes that meet pairwise.
*Odd sketch.*  Of every node in this join, ``ODD_BITS`` bits say whether an odd number of its shingles falls on each of them.  Shingles in common cancel out,
so two sets have at least as many shingles apart as bits that differ: a bound that holds for every pair, and what it excludes never becomes a row.
*Verification.*  Pairs with a smallest node are looked at exactly if the sizes of the sets allow a link and the signatures agree in
``least_equal`` registers (a miss of at most ``FILTER_MISS``), pairs of the prefix join always: Jaccard similarity of the two
shingle sets, at least ``SIMILARITY``.  Bands and ``least_equal`` follow from the similarity asked for; the bands miss a pair just as similar with less than ``MISS``.
*Classes* are the connected components of the verified links, so no link between different texts is lost by the shortcuts.

Null texts and texts without words are alone in their class.  Rows that repeat an
id and its text are one document twice and stay in one class.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictorium.plans.scratch import Scratch

from .common import OWN, row_batches, schema_plus, texts, words_of

SHINGLE = 5
SIMILARITY = 0.8
REGISTERS = 64
#: Chance that the registers' filter, and that the bands, miss a pair just as similar as asked for.
FILTER_MISS = 2e-6
MISS = 5e-4
#: Nodes of one shingle that meet in one cell of the prefix join.
BLOCK = 1_000
#: Bits of an odd sketch, a multiple of 64.
ODD_BITS = 1024
#: Bounds are compared with this allowance, so rounding loses no pair.
SLACK = 1e-6


def least_equal(similarity: float, registers: int = REGISTERS, miss: float = FILTER_MISS) -> int:
    """The most equal registers to ask for: fewer have at most the chance ``miss`` at this similarity."""
    below = 0.0
    for k in range(registers + 1):
        below += math.comb(registers, k) * similarity**k * (1 - similarity) ** (registers - k)
        if below > miss:
            return k
    return registers


def bands_for(similarity: float) -> tuple[int, int]:
    """(registers of a band, bands): the longest bands whose number fits the stored registers."""

    def bands(size: int) -> int:
        return max(1, math.ceil(math.log(MISS) / math.log1p(-(similarity**size)))) if similarity < 1 else 1

    size = max((k for k in range(1, REGISTERS + 1) if k * bands(k) <= REGISTERS), default=1)
    return size, REGISTERS // size


_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing generator: all output bits depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(words: list[bytes], seen: dict[bytes, int]) -> np.ndarray:
    """Hash of every shingle, in order; ``seen`` remembers word hashes."""
    if len(seen) > 500_000:
        seen.clear()
    h = np.empty(len(words), _U)
    for i, w in enumerate(words):
        v = seen.get(w)
        if v is None:
            v = seen[w] = xxhash.xxh64_intdigest(w)
        h[i] = v
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, _U)
    for k in range(size):
        out = out * _U(0x9E3779B97F4A7C15) + h[k : k + n]
    return _mix(out)


def signatures(sets: list[np.ndarray], counts: list[np.ndarray], m: int = REGISTERS, at_once: int = 1) -> np.ndarray:
    """ProbMinHash registers of every non-empty weighted set, as 16-bit marks.  ``at_once`` arrivals of an
    element are drawn in one step; it changes the speed only."""
    n = len(sets)
    h = np.concatenate(sets) if n else np.zeros(0, _U)
    rate = 1 + np.log(np.concatenate(counts)) if n else np.zeros(0)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    when = np.full(n * m, np.inf)
    mark = np.zeros(n * m, np.int16)
    time = np.zeros(len(h))
    r = 0
    while len(h):
        number = (2 * np.arange(r, r + at_once, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
        bits = _mix(h[:, None] + number)
        gaps = -np.log1p(-(bits >> _U(11)).astype(float) / 9007199254740992.0) / rate[:, None]
        gaps[:, 0] += time
        times = np.cumsum(gaps, axis=1)
        slot = (owner[:, None] * m + (_mix(bits ^ _U(0xD6E8FEB86659FD93)) % _U(m)).astype(np.int64)).ravel()
        np.minimum.at(when, slot, times.ravel())
        won = when[slot] == times.ravel()
        mark[slot[won]] = np.repeat((h & _U(0xFFFF)).astype(np.uint16).view(np.int16), at_once)[won]
        time = times[:, -1]
        going = time < when.reshape(n, m).max(axis=1)[owner]
        h, rate, owner, time = h[going], rate[going], owner[going], time[going]
        r += at_once
    return mark.reshape(n, m)


def text_mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketch(docs: DataFrame) -> DataFrame:
    """row number, doc_id, ``mark`` (a hash of the text, which tells rows with one id apart), node (null
    without words), signature and the shingle set as sorted 32-bit values."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_mark().alias("mark"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in row_batches(batches, 4 << 20):
            nodes, sets, where = [], [], []
            for i, text in enumerate(texts(batch)):
                words = words_of(text)
                if not words:
                    nodes.append(None)
                    continue
                s = np.unique(shingles(words, seen))
                nodes.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                sets.append(s)
                where.append(i)
            signed = signatures(sets, [np.ones(len(s)) for s in sets])
            sig: list = [None] * batch.num_rows
            small: list = [None] * batch.num_rows
            for i, row, s in zip(where, signed, sets):
                sig[i] = row
                small[i] = np.unique((s >> _U(32)).astype(np.uint32).view(np.int32))
            arrays = [batch.column("row"), batch.column("doc_id"), batch.column("mark"), pa.array(nodes, pa.int64()), pa.array(sig, pa.list_(pa.int16())), pa.array(small, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "mark", "node", "sig", "set"])

    return docs.mapInArrow(run, schema_plus(docs, ["row", "doc_id", "mark"], node="long", sig="array<short>", set="array<int>"))


def odd_sketches(sets: DataFrame) -> DataFrame:
    """(node, odd) of (node, set): the bits on which an odd number of shingles fall, as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 2048) for b in row_batches(batches, 4 << 20) for at in range(0, b.num_rows, 2048)):
            column = batch.column("set")
            sizes = np.diff(column.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            bit = column.flatten().to_numpy() & (ODD_BITS - 1)
            odd = np.bincount(owner * ODD_BITS + bit, minlength=len(sizes) * ODD_BITS) & 1
            words = np.packbits(odd.astype(np.uint8)).view(np.int64)
            ends = np.arange(len(sizes) + 1, dtype=np.int32) * (ODD_BITS // 64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(ends, words)], names=["node", "odd"])

    return sets.select("node", "set").mapInArrow(run, "node long, odd array<long>")


def _bucket_keys(size: int, n: int) -> Column:
    """Buckets by ``n`` bands of ``size`` registers of the stored signature."""
    if size * n > REGISTERS:
        raise ValueError(f"{n} bands of {size} registers need more than {REGISTERS}")
    numbers = F.from_json(F.lit(json.dumps([list(range(k * size, (k + 1) * size)) for k in range(n)])), "array<array<int>>")
    return F.transform(numbers, lambda band, k: F.xxhash64(k, F.transform(band, lambda i: F.get("sig", i))))


def contract(edges: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(node, label) of all nodes with an edge (a, b); label is the smallest node of the component.

    Every node hooks onto its smallest neighbour, edges are drawn anew between what
    the ends hooked onto, and copies and loops go; so the graph shrinks until no edge is left.  The hooks are
    then followed from the first round to the last.  Edges and hooks are written tables; the
    edges of one node may be any number."""
    edges, seen = scratch.write(edges.select("a", "b").filter("a != b"), n=F.count(F.lit(1)))
    hooks = []
    while seen["n"]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook, _ = scratch.write(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
        hooks.append(hook)
        ends = edges.join(hook.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(hook.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        drawn = ends.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges, seen = scratch.write(drawn, n=F.count(F.lit(1)))
    return _follow(hooks)


def _follow(hooks: list[DataFrame]) -> DataFrame | None:
    if not hooks:
        return None
    labels = hooks[0]
    for hook in hooks[1:]:
        to = hook.select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return labels


class _Finder:
    """The steps of one run over a table of :func:`sketch`."""

    def __init__(self, prints: DataFrame, scratch: Scratch, similarity: float, bands: tuple[int, int] | None, block: int):
        self.scratch, self.similarity, self.block = scratch, similarity, block
        self.bands, self.least_equal = bands or bands_for(similarity), least_equal(similarity)
        self.prints = prints.filter(F.col("node").isNotNull())
        firsts, _ = scratch.write(self.prints.groupBy("node").agg(F.min("row").alias("row")).select("row"))
        self.sigs, _ = scratch.write(self.prints.select("row", "node", "sig", F.size("set").alias("n")).join(firsts, "row", "left_semi"))
        self.sets = None
        #: classes so far, as (node, label); nodes that are missing are alone
        self.labels: DataFrame | None = None

    def members(self) -> DataFrame:
        """(bucket, node, low) of buckets with several nodes; low is the smallest of them."""
        rows = self.sigs.select("node", F.explode(_bucket_keys(*self.bands)).alias("bucket"))
        shared = rows.groupBy("bucket").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared, _ = self.scratch.write(shared.select("bucket", "low"))
        members, _ = self.scratch.write(rows.join(shared, "bucket"))
        self.scratch.drop(shared)
        return members

    def keep_sets(self, nodes: DataFrame) -> None:
        """Shingle sets of the nodes that share a bucket: all that later steps can ask for."""
        rows = self.sigs.join(nodes, "node", "left_semi").select("row", "node")
        self.sets, _ = self.scratch.write(self.prints.select("row", "set").join(rows, "row").select("node", "set"))

    def signature(self, x: str) -> DataFrame:
        """Node, signature and set size under the names of side ``x`` of a pair."""
        return self.sigs.select(F.col("node").alias(x), F.col("sig").alias("sig_" + x), F.col("n").alias("n_" + x))

    def may_link(self) -> Column:
        """False only where the set sizes of a and b exclude a link, or too few registers agree."""
        sizes = F.least("n_a", "n_b") >= self.similarity * F.greatest("n_a", "n_b")
        return sizes & (_equal_registers("sig_a", "sig_b") >= self.least_equal)

    def stars(self, members: DataFrame) -> DataFrame:
        """Nodes with the smallest node of their bucket, where the signatures allow a link."""
        pairs = members.filter("node != low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
        pairs = pairs.join(self.signature("b"), "b")
        sigs = self.signature("a")
        return pairs.join(sigs, (pairs["a"] == sigs["a"]) & self.may_link()).select(pairs["a"], "b")

    def ranked(self, nodes: DataFrame) -> DataFrame:
        """(node, cls, odd, n, t, p): shingles of the nodes (node, cls, odd) that can be the first one in common with a node of
        another set, with their 0-based positions p when the shingles held by fewer of these nodes come first."""
        tokens = self.sets.select("node", F.size("set").alias("n"), F.explode("set").alias("t"))
        common = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.min("n").alias("least")).filter("df > 1")
        common, _ = self.scratch.write(common)
        held = tokens.join(common, "t").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t", "least"))).alias("held"))
        alone = F.col("n") - F.size("held")  # shingles of this node only, in front of all others
        room = F.floor(F.col("n") * (1 - self.similarity) + SLACK).cast("int") + 1
        held = held.select("node", "n", alone.alias("alone"), F.slice("held", 1, F.greatest(F.lit(0), room - alone)).alias("held"))
        rows = held.select("node", "n", "alone", F.posexplode("held").alias("k", "s")).select("node", "n", "s.t", "s.least", (F.col("alone") + F.col("k")).alias("p"))
        rows = rows.filter(self.room_for("n", "p", F.col("n") + F.greatest("least", F.col("n") * self.similarity)))
        rows, _ = self.scratch.write(rows.join(nodes, "node").select("node", "cls", "odd", "n", "t", "p"))
        self.scratch.drop(common)
        return rows

    def room_for(self, n: str, p: str, both: Column) -> Column:
        """False only if sets of together ``both`` shingles, with nothing in common before position p of n, cannot be similar."""
        return (F.col(n) - F.col(p)) * (1 + self.similarity) + SLACK >= both * self.similarity

    def near_enough(self) -> Column:
        """False only if the odd sketches of a and b prove too many shingles apart."""
        apart = [F.bit_count(F.get("odd_a", i).bitwiseXOR(F.get("odd_b", i))) for i in range(ODD_BITS // 64)]
        return reduce(Column.__add__, apart) <= (F.col("n_a") + F.col("n_b")) * ((1 - self.similarity) / (1 + self.similarity)) + SLACK

    def across(self, nodes: DataFrame) -> DataFrame:
        """All pairs (a, b) of nodes (node, cls) of different classes that the prefix join and the odd sketches leave."""
        rows = self.ranked(nodes.join(odd_sketches(self.sets), "node"))
        sizes = rows.groupBy("t").agg(F.ceil(F.count(F.lit(1)) / self.block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("held"))
        sizes, _ = self.scratch.write(sizes.filter("held > 1").select("t", "blocks"))
        rows = rows.join(sizes, "t").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        a = rows.select("t", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("node").alias("a"), F.col("cls").alias("cls_a"), F.col("n").alias("n_a"), F.col("p").alias("p_a"), F.col("odd").alias("odd_a"))
        b = rows.select(F.col("t").alias("t_b"), F.explode(F.sequence(F.lit(0), "block")).alias("i_b"), F.col("block").alias("j_b"), F.col("node").alias("b"), F.col("cls").alias("cls_b"), F.col("n").alias("n_b"), F.col("p").alias("p_b"), F.col("odd").alias("odd_b"))
        both = F.col("n_a") + F.col("n_b")
        meet = (a["t"] == b["t_b"]) & (a["i"] == b["i_b"]) & (a["j"] == b["j_b"])
        once = (F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))
        room = self.room_for("n_a", "p_a", both) & self.room_for("n_b", "p_b", both)
        pairs = a.join(b, meet & once & (F.col("cls_a") != F.col("cls_b")) & room & self.near_enough())
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are similar."""
        near, _ = self.scratch.write(pairs.distinct())  # before the sets are fetched
        both = near.join(self.sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        both = both.join(self.sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        common = F.size(F.array_intersect("set_a", "set_b"))
        union = F.size("set_a") + F.size("set_b") - common
        return both.filter(common >= self.similarity * union).select("a", "b")

    def named(self, rows: DataFrame, node: str = "node") -> DataFrame:
        """Rows with the class of their node (``cls``)."""
        if self.labels is None:
            return rows.withColumn("cls", F.col(node))
        to = self.labels.select(F.col("node").alias(node), F.col("label").alias("cls"))
        rest = [c for c in rows.columns if c != node]
        return rows.join(to, node, "left").select(*rest, node, F.coalesce("cls", node).alias("cls"))

    def link(self, edges: DataFrame) -> None:
        """Joins the classes at the ends of new links."""
        a = self.named(edges, "a").select("b", F.col("cls").alias("x"))
        new = contract(self.named(a, "b").select(F.col("x").alias("a"), F.col("cls").alias("b")), self.scratch)
        if new is None:
            return
        if self.labels is not None:  # old nodes follow their label, labels that were alone are new nodes
            to = new.select(F.col("node").alias("label"), F.col("label").alias("to"))
            old = self.labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            new = old.unionByName(new.join(self.labels.select("node"), "node", "left_anti"))
        self.labels, _ = self.scratch.write(new)

    def run(self) -> DataFrame | None:
        members = self.members()
        self.keep_sets(members.select("node").distinct())
        self.link(self.linked(self.stars(members)))
        named, _ = self.scratch.write(self.named(members.select("bucket", "node")))
        self.scratch.drop(members)
        mixed = named.groupBy("bucket").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low < high")
        mixed, _ = self.scratch.write(mixed.select("bucket"))
        nodes, seen = self.scratch.write(named.join(mixed, "bucket").select("node", "cls").distinct(), n=F.count(F.lit(1)))
        self.scratch.drop(named)
        if seen["n"]:
            sets, _ = self.scratch.write(self.sets.join(nodes.select("node"), "node", "left_semi"))
            self.scratch.drop(self.sets)
            self.sets = sets
            self.link(self.linked(self.across(nodes)))
        return self.labels


def _equal_registers(a: str, b: str) -> Column:
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda acc, x: acc + x)


def _grouped(docs: DataFrame, similarity: float, bands: tuple[int, int] | None, block: int) -> DataFrame:
    """doc_id, mark, class_id, class_size and kept per row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "near")
    prints, _ = scratch.write(sketch(docs))
    finder = _Finder(prints, scratch, similarity, bands, block)
    finder.run()
    words = F.col("node").isNotNull()
    rows = finder.named(prints.select("doc_id", "mark", "node"))
    rows, _ = scratch.write(rows.select("doc_id", "mark", F.when(words, F.col("cls")).alias("cls")))
    scratch.drop(prints)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    heads, _ = scratch.write(rows.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("n")))
    found = rows.join(heads, "cls", "left")
    head = F.coalesce("head", order)  # a text without words is its own class
    return found.select(
        "doc_id",
        "mark",
        head["doc_id"].alias("class_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("class_size"),
        order.eqNullSafe(head).alias("kept"),
    )


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: tuple[int, int] | None = None, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of the class), class_size, kept."""
    return _grouped(docs, similarity, bands, block).drop("mark")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: tuple[int, int] | None = None, block: int = BLOCK) -> DataFrame:
    """The documents without those that are not kept; rows that repeat id and text of a kept one stay."""
    gone = _grouped(docs, similarity, bands, block).filter(~F.col("kept"))
    gone = gone.select(F.struct("doc_id", "mark").alias(OWN + "gone")).distinct()
    gone, _ = Scratch(docs.sparkSession, "near").write(gone)
    own = F.struct(F.col("doc_id"), text_mark().alias("mark"))
    rows = docs.withColumn(OWN + "row", own)
    return rows.join(gone, rows[OWN + "row"].eqNullSafe(gone[OWN + "gone"]), "left_anti").select(*docs.columns)
