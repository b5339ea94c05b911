"""Secrets in text: fixed patterns plus sliding-window Shannon entropy.

One map stage, no shuffle.  A document is scanned once for *candidate strings*
(maximal runs of the Base64/URL alphabet of at least one window).  Inside a
candidate, each character class is looked at by itself: a window slides over the
runs of that class and keeps the count of every symbol.  Moving it by one
character changes two counts, so its entropy

    H = log2(w) - (1/w) * sum(c * log2(c))

is updated in constant time, whatever the window size.  Overlapping windows over
the threshold merge into one span.  Candidates that an allow-list pattern finds
are not reported by entropy (the fixed patterns stay).

Null text is empty; rows repeat as they are; one output row per input row.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import OWN, row_batches, schema_plus, single, texts, with_columns

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24


class CharacterClass(NamedTuple):
    """A class of characters with its window and the entropy that counts as random."""

    kind: str
    pattern: str
    window: int
    bits: float


CLASSES = (
    CharacterClass("entropy_hex", r"[0-9A-Fa-f]+", 20, 3.0),
    CharacterClass("entropy_upper", r"[A-Z0-9]+", 20, 3.4),
    CharacterClass("entropy_base64", r"[A-Za-z0-9+/_=-]+", 20, 3.9),
)

#: Candidates that look random but are no secrets.
ALLOW = (
    r"(?i)example|placeholder|changeme|dummy|sample|redacted",
    r"^[0-9]+$",  # numbers
    r"^[a-z]+$|^[A-Z]?[a-z]+$",  # long words
    r"^(?:[a-z]+[-_/])+[a-z]+$",  # slugs and paths of words
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # UUIDs
    r"(?i)0123456789abcdef|abcdefghijklmnop",
)


def entropy_spans(s: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged ``[start, end)`` of all windows of ``s`` with entropy >= ``bits``."""
    n = len(s)
    if n < window:
        return []
    # c * log2(c) for every count a window can hold
    clog = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    most = (math.log2(window) - bits) * window + 1e-9
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[tuple[int, int]] = []
    for i, ch in enumerate(s):
        if i >= window:
            old = s[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += clog[c - 1] - clog[c]
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += clog[c + 1] - clog[c]
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


class Scanner:
    def __init__(self, classes=CLASSES, allow=ALLOW):
        self.classes = [(c.kind, re.compile(c.pattern), c.window, c.bits) for c in classes]
        self.allow = re.compile("|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in allow)) if allow else None
        least = min([c.window for c in classes] + [ACCESS_LEAST, HEX_LEAST])
        # every access key, hex run and window lies inside one candidate
        self.candidate = re.compile(rf"[A-Za-z0-9+/_=-]{{{least},}}")
        self.order = {k: i for i, k in enumerate(["assign", "access", "hex"] + [c.kind for c in classes])}

    def base(self, text: str, candidates) -> list[tuple[int, int, str]]:
        found = []
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        for at, s in candidates:
            found += [(at + m.start(), at + m.end(), "access") for m in ACCESS.finditer(s) if len(m[0]) >= ACCESS_LEAST]
            found += [(at + m.start(), at + m.end(), "hex") for m in HEX.finditer(s) if len(m[0]) >= HEX_LEAST]
        return found

    def scan(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans and entropy spans, as (start, end, kind), sorted."""
        candidates = [(m.start(), m[0]) for m in self.candidate.finditer(text)]
        base = self.base(text, candidates)
        more = []
        for at, s in candidates:
            if self.allow and self.allow.search(s):
                continue
            for kind, pattern, window, bits in self.classes:
                for run in pattern.finditer(s):
                    more += [(at + run.start() + a, at + run.start() + b, kind) for a, b in entropy_spans(run[0], window, bits)]
        key = lambda x: (x[0], self.order[x[2]])
        return sorted(base, key=key), sorted(more, key=key)


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, classes=CLASSES, allow=ALLOW) -> DataFrame:
    """All secrets of every document: doc_id, counts, digest of the base spans
    and ``spans`` (base and entropy) as ``kind:start:end`` in code points."""
    docs = single(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allow)
        for batch in row_batches(batches):
            out = []
            for text in texts(batch):
                base, more = scanner.scan(text)
                kinds = [k for _, _, k in base]
                spans = sorted(base + more, key=lambda x: (x[0], scanner.order[x[2]]))
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                out.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, _joined(spans), len(more)))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds_ = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"]
            yield with_columns(batch, ["doc_id"], **{n: pa.array(list(c), t) for n, c, t in zip(names, cols, kinds_)})

    schema = schema_plus(docs, ["doc_id"], n_assign="long", n_access="long", n_hex="long", base_sha256="string", spans="string", n_entropy="long")
    return docs.mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, mask: str = "<secret>", classes=CLASSES, allow=ALLOW) -> DataFrame:
    """The documents with every found span (merged where they overlap) replaced."""
    keep = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allow)
        for batch in row_batches(batches):
            out = []
            for text in batch.column("text").to_pylist():
                base, more = scanner.scan(text or "")
                pieces, at = [], 0
                for a, b, _ in sorted(base + more):
                    if a >= at:
                        pieces += [text[at:a], mask]
                    at = max(at, b)
                out.append("".join(pieces) + text[at:] if at else text)
            arrays = [pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(arrays, names=keep)

    return docs.mapInArrow(run, schema_plus(docs, keep))


__all__ = ["CLASSES", "ALLOW", "OWN", "CharacterClass", "Scanner", "entropy_spans", "redact_secrets", "scan_secrets"]
