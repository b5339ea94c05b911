"""Cost-balanced packing of tokenised documents into sequences.

Attention over n tokens costs about ``linear * n + quadratic * n * n``.  Balanced
sequences should hold documents of like total cost, so documents (or what is left of a
long one) are taken in descending length and put into the sequence with the lowest
cost so far that still has room: a heap keeps the open sequences by cost.

One map stage, no shuffle: a task tokenises its documents and packs them in *groups* of up
to ``group_tokens`` tokens, so memory is bounded and no group of sequences depends
on another task.  Inside a group:

* whole multiples of the sequence length are cut off a document and fill sequences of their own;
* the remainders go to exactly as many sequences as their tokens fill.  Their
  capacities add up to the tokens: full sequences, and the rest (fewer tokens than one
  sequence) as powers of two, which need no padding;
* when the cheapest open sequence cannot hold all of a remainder, it takes what fits and the
  next cheapest takes the rest.  So every sequence is full, and padding is zero.

Null text is empty; an empty text still has its end token.  Repeated rows are packed as
documents of their own.  An empty table gives no rows.  ``sequence_id`` is the
task's partition number and a running number; a task that runs again makes the
same ones.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import row_batches, schema_plus, single, texts

SEQUENCE_TOKENS = 1024
GROUP_TOKENS = 4_000_000
END_ID = 0
#: Relative costs of one token in the linear layers and of one pair of tokens in attention.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


def default_vocabulary() -> str:
    """The ranks of ``byte_bpe_50k``: the same ids as its JSON form, from a faster reader."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_encoders: dict[str, object] = {}
_exact: list = []


def encoder(path: str):
    """Byte-level BPE read from a rank file; once per worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
    return _encoders[path]


def encode(bpe, text: str, path: str) -> list[int]:
    """Ids of a text.  On a run of about a million white-space characters the reader of the rank file
    gives up; such a text is encoded from the JSON form of ``byte_bpe_50k``, which has no such limit."""
    try:
        return bpe.encode(text, allowed_special="all")
    except ValueError:
        if path != default_vocabulary():
            raise
        if not _exact:
            import public_tokenizers
            from tokenizers import Tokenizer

            _exact.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
        return _exact[0].encode(text, add_special_tokens=False).ids


def capacities(tokens: int, full: int = SEQUENCE_TOKENS) -> list[int]:
    """Capacities that add up to ``tokens``: full ones, then powers of two."""
    rest = tokens % full
    return [full] * (tokens // full) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], full: int = SEQUENCE_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a group."""
    pieces, rests, sequence = [], [], 0
    for d, n in enumerate(lengths):
        whole = n // full
        for k in range(whole):
            pieces.append((d, k * full, full, sequence, 0))
            sequence += 1
        if n % full:
            rests.append((n % full, whole * full, d))
    room = capacities(sum(r[0] for r in rests), full)
    used = [0] * len(room)
    # ties: the roomier sequence, then the earlier one
    heap = [(0.0, -c, s) for s, c in enumerate(room)]
    heapq.heapify(heap)
    rests.sort(key=lambda r: (-r[0], r[2]))
    for n, start, d in rests:
        while n:
            cost, _, s = heapq.heappop(heap)
            take = min(n, room[s] - used[s])
            pieces.append((d, start, take, sequence + s, used[s]))
            used[s] += take
            n -= take
            start += take
            if used[s] < room[s]:
                heapq.heappush(heap, (cost + linear * take + quadratic * take * take, used[s] - room[s], s))
    return pieces


def pack_documents(docs: DataFrame, vocabulary: str | None = None, full: int = SEQUENCE_TOKENS, group_tokens: int = GROUP_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset; with ``with_ids`` also the token ids themselves."""
    docs = single(docs)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        first = TaskContext.get().partitionId() << 40
        ids_of: list[np.ndarray] = []
        owners: list = []
        kind = None

        def flush():
            nonlocal first
            pieces = pack([len(x) for x in ids_of], full, linear, quadratic)
            cols: list[list] = [[] for _ in range(7)]
            parts = []
            for d, start, n, s, offset in pieces:
                part = ids_of[d][start : start + n]
                for c, v in zip(cols, (owners[d], start, n, zlib.crc32(part.data), len(ids_of[d]), first + s, offset)):
                    c.append(v)
                parts.append(part)
            first += max((p[3] for p in pieces), default=-1) + 1
            ids_of.clear()
            owners.clear()
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [pa.array(cols[0], kind)] + [pa.array(c, pa.int64()) for c in cols[1:]]
            if with_ids:
                flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
                ends = np.cumsum([0] + [len(p) for p in parts], dtype=np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        waiting = 0
        for batch in row_batches(batches, 4 << 20):
            kind = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids = encode(bpe, text, path)
                ids.append(END_ID)
                ids_of.append(np.array(ids, "<u4"))
                owners.append(doc)
                waiting += len(ids)
                if waiting >= group_tokens:
                    yield flush()
                    waiting = 0
        if ids_of:
            yield flush()

    schema = schema_plus(docs, ["doc_id"], start="long", length="long", ids_crc32="long", doc_tokens="long", sequence_id="long", offset="long", **({"ids": "array<int>"} if with_ids else {}))
    return docs.mapInArrow(run, schema)
