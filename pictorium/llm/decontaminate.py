"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items form one automaton (``SuffixAutomaton``): every
sub-sequence of every item is a path from its root.  The words of a document
stream through it; the automaton keeps the longest suffix of what was read that
occurs in some item.  When that match is as long as a *window* (ten words, or a
whole shorter item) its words are hit.  Matched spans are removed, and documents
covered beyond a limit are removed as a whole.

The document side is map-only: no shuffle, whatever the number of documents, so
no key can be hot.  The items go to the tasks in blocks of a bounded number of words,
compressed, up to ``STEP_BLOCKS`` blocks in one map step.  The step runs a batch of documents through one
block after another and holds one automaton at a time (all of them while there are no more than ``HELD``), so a larger
benchmark costs time, not memory.  Beyond one step's blocks the hits found so far are written
to a table before the next step, so no two steps' workers run side by side.  The driver holds the compressed blocks of a step.

Null and word-free texts have no words, are never contaminated, and are kept.
Repeated documents are treated alike; repeated items count once per item id; a
null item id is written as the empty string.  An empty benchmark hits nothing.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pictorium.plans.scratch import Scratch

from .common import OWN, WORD_BYTES, row_batches, schema_plus, texts, with_columns, words_of

WINDOW = 10
BLOCK_WORDS = 100_000
#: Blocks of one map step: 6.4 million words, compressed a few bytes each.
STEP_BLOCKS = 64
#: Automata that a worker keeps between batches.
HELD = 4
TOTAL, CUT = OWN + "total", OWN + "cut"
HITS, ITEMS, WORDS, LONGEST = OWN + "hits", OWN + "items", OWN + "n_words", OWN + "longest"


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences.

    ``windows[state]``: (length, item ids) of the item windows that the state
    stands for; ``above[state]``: the nearest state on the suffix path, itself
    included, that has windows (0 if none)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocab: dict[bytes, int] = {}
        self.window = window
        rows = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for item, words in items if words]
        for _, ids in rows:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.windows: dict[int, dict[int, set[str]]] = {}
        self.shortest = window
        for item, ids in rows:
            m = min(window, len(ids))
            self.shortest = min(self.shortest, m)
            state = n = 0
            for c in ids:
                state, n = self.step(state, n, c)
                if n >= m:
                    self.windows.setdefault(self._holder(state, m), {}).setdefault(m, set()).add(item)
        self.above = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.above[s] = s if s in self.windows else self.above[self.link[s]]

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """State for the sequences of ``q`` that are no longer than ``p`` + c."""
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier item has this sequence
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        state = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return state

    def _holder(self, state: int, m: int) -> int:
        """State that stands for the last ``m`` words of ``state``'s match."""
        while self.length[self.link[state]] >= m:
            state = self.link[state]
        return state

    def step(self, state: int, n: int, c: int) -> tuple[int, int]:
        while c not in self.next[state]:
            state = self.link[state]
            if state == -1:
                return 0, 0
            n = self.length[state]
        return self.next[state][c], n + 1

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set[str], int]:
        """Merged hit spans [first, past last) in words, items with a window in
        the words, and the longest match of any kind."""
        spans: list[list[int]] = []
        items: set[str] = set()
        nxt, link, length, get = self.next, self.link, self.length, self.vocab.get
        shortest, longest = self.shortest, 0
        state = n = 0
        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                state = n = 0
                continue
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(c)
            if to is None:
                n = 0
                continue
            state = to
            n += 1
            if n > longest:
                longest = n
            if n < shortest:
                continue
            s = self.above[state]
            while s > 0:
                for m, ids in self.windows[s].items():
                    if m <= n:
                        items |= ids
                        self._add(spans, i - m + 1, i + 1)
                s = self.above[link[s]]
        return spans, items, longest

    @staticmethod
    def _add(spans: list[list[int]], a: int, b: int) -> None:
        while spans and spans[-1][1] >= a:
            x = spans.pop()
            a, b = min(a, x[0]), max(b, x[1])
        spans.append([a, b])


_built: dict[tuple[str, int, int], SuffixAutomaton] = {}


def _pack(block: list) -> bytes:
    return zlib.compress(pickle.dumps(block))


def _automata(name: str, blocks, window: int) -> Iterator[SuffixAutomaton]:
    """The automata of a step's blocks, one after another.  Few of them are built once in a Python worker,
    which serves many tasks; of many, one is held at a time."""
    for k, packed in enumerate(blocks):
        automaton = _built.get((name, k, window))
        if automaton is None:
            if len(_built) >= HELD or len(blocks) > HELD:
                _built.clear()
            automaton = SuffixAutomaton([(item, words_of(text)) for item, text in pickle.loads(zlib.decompress(packed))], window)
            if len(blocks) <= HELD:
                _built[name, k, window] = automaton
        yield automaton
        del automaton


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS):
    """Blocks of (item id, text) with at most ``block_words`` words each (an item
    is never cut), read one partition at a time."""
    block, n = [], 0
    for row in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").toLocalIterator():
        size = len(words_of(row["text"] or ""))
        if block and n + size > block_words:
            yield block
            block, n = [], 0
        block.append((row["i"], row["text"] or ""))
        n += size
    yield block


def _merged(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for x, y in sorted(a + b):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, step_blocks: int = STEP_BLOCKS) -> DataFrame:
    """``docs`` plus hit spans (flat word positions), items, number of words and
    longest match, in columns with a reserved prefix."""
    keep = docs.columns
    out = docs.withColumn(HITS, F.array().cast("array<int>")).withColumn(ITEMS, F.array().cast("array<string>"))
    out = out.withColumn(WORDS, F.lit(0).cast("long")).withColumn(LONGEST, F.lit(0).cast("long"))
    schema = schema_plus(docs, keep, **{HITS: "array<int>", ITEMS: "array<string>", WORDS: "long", LONGEST: "long"})
    scratch, before = Scratch(docs.sparkSession, "hits"), None
    for step, packed in enumerate(batched(map(_pack, item_blocks(items, block_words)), step_blocks)):
        if step:
            table = scratch.write(out)[0]
            scratch.drop(before)
            out = before = table
        out = out.mapInArrow(_matcher(docs.sparkSession.sparkContext.broadcast(packed), keep, window), schema)
    return out


def _matcher(shared, keep: list[str], window: int):
    """Map step that adds the hits of a step's blocks to those found before."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            words = [words_of(text) for text in texts(batch)]
            hits = [list(map(list, zip(flat[::2], flat[1::2]))) for flat in batch.column(HITS).to_pylist()]
            found = [set(ids) for ids in batch.column(ITEMS).to_pylist()]
            longest = batch.column(LONGEST).to_pylist()
            for automaton in _automata(name, shared.value, window):
                for i, own in enumerate(words):
                    spans, ids, most = automaton.match(own)
                    if spans:
                        hits[i] = _merged(spans, hits[i]) if hits[i] else spans
                        found[i] |= ids
                    longest[i] = max(longest[i], most)
            new = {
                HITS: pa.array([[x for s in spans for x in s] for spans in hits], pa.list_(pa.int32())),
                ITEMS: pa.array([sorted(ids) for ids in found], pa.list_(pa.string())),
                WORDS: pa.array([len(own) for own in words], pa.int64()),
                LONGEST: pa.array(longest, pa.int64()),
            }
            yield with_columns(batch, keep, **new)

    return run


def _without(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD_BYTES.finditer(data.lower())]
    pieces, at = [], 0
    for a, b in spans:
        pieces.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*pieces, data[at:]]).decode("utf-8", "surrogatepass")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: n_words, n_hit, n_items, digest of the sorted item ids,
    contaminated, longest match and the share of hit words."""
    found = scan(docs.select("doc_id", "text"), items, window, block_words)
    # spans are flat (a1, b1, a2, b2, ...): their total is the sum with alternating signs
    total = F.aggregate(F.transform(HITS, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return found.select(
        "doc_id",
        F.col(WORDS).alias("n_words"),
        total.alias("n_hit"),
        F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ITEMS), ","), 256).alias("items_sha256"),
        (F.size(HITS) > 0).alias("contaminated"),
        F.col(LONGEST).alias("longest"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without hit spans; those with more than ``max_coverage`` of
    their words hit are left out.  Clean documents pass unchanged.

    Taking a span out may join words to a new window, so a text is looked at again until nothing is hit.  The hits
    of all blocks are found on the same text, and their union is cut; so the result does not depend on the blocks.
    Coverage is measured on the original words.  One block does all in one map step; with several, every pass
    writes a table, and only documents with a hit go on to the next pass."""
    blocks = item_blocks(items, block_words)
    first = next(blocks)
    if next(blocks, None) is None:
        out = _cut_by_block(docs, first, window)
    else:
        out = _cut_by_passes(docs, items, window, block_words)
    return out.filter((F.col(CUT) == 0) | (F.col(CUT) <= max_coverage * F.col(TOTAL))).select(*docs.columns)


def _cut_by_block(docs: DataFrame, block: list, window: int) -> DataFrame:
    """``docs`` without hit spans, with the number of original words and of cut words."""
    keep = docs.columns
    shared, name = docs.sparkSession.sparkContext.broadcast((_pack(block),)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (automaton,) = _automata(name, shared.value, window)
        for batch in row_batches(batches):
            new, totals, cuts = [], [], []
            for text in batch.column("text").to_pylist():
                words, gone = words_of(text or ""), 0
                spans, _, _ = automaton.match(words)
                while spans:
                    gone += sum(b - a for a, b in spans)
                    text = _without(text, spans)
                    spans, _, _ = automaton.match(words_of(text))
                new.append(text)
                totals.append(len(words))
                cuts.append(gone)
            yield _with_text(batch, keep, new, **{TOTAL: totals, CUT: cuts})

    return docs.mapInArrow(run, schema_plus(docs, keep, **{TOTAL: "long", CUT: "long"}))


def _cut_by_passes(docs: DataFrame, items: DataFrame, window: int, block_words: int) -> DataFrame:
    """The same over all blocks of the items."""
    keep = docs.columns
    scratch = Scratch(docs.sparkSession, "decontaminate")
    schema = schema_plus(docs, keep, **{TOTAL: "long", CUT: "long"})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, totals, cuts = [], [], []
            state = (batch.column(c).to_pylist() for c in ("text", HITS, WORDS, TOTAL, CUT))
            for text, hits, words, total, gone in zip(*state):
                spans = list(zip(hits[::2], hits[1::2]))
                new.append(_without(text, spans))
                totals.append(words if total < 0 else total)
                cuts.append(gone + sum(b - a for a, b in spans))
            yield _with_text(batch, keep, new, **{TOTAL: totals, CUT: cuts})

    hit = F.size(HITS) > 0
    rows, clean = docs.withColumn(TOTAL, F.lit(-1).cast("long")).withColumn(CUT, F.lit(0).cast("long")), []
    while True:
        found, seen = scratch.write(scan(rows, items, window, block_words), hit=F.count_if(hit))
        clean.append(found.filter(~hit).select(*keep, TOTAL, CUT))
        if not seen["hit"]:
            break
        rows = found.filter(hit).mapInArrow(cut, schema)
    out = clean[0]
    for more in clean[1:]:
        out = out.unionByName(more)
    return out


def _with_text(batch: pa.RecordBatch, keep: list[str], texts: list, **new: list) -> pa.RecordBatch:
    arrays = [pa.array(texts, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in keep]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array(v, pa.int64()) for v in new.values())], names=[*keep, *new])
