"""Segmentation of text without spaces by a dictionary: a word graph and its best route.

*Dictionary.*  Words with frequencies, stored as a trie in three flat arrays: sorted edges ``node * 2^21 + character``, the node each leads to, and
per node the weight of the word that ends there.  Arrays are small (20 bytes a node) and broadcast once.
*Word graph.*  All positions of all texts of a batch walk the trie together, one character a step, so finding every dictionary
word takes as many array steps as the longest word has characters.
*Best route.*  From the end of a text backwards, each position takes the word with the largest sum of weights, of equal ones the longer. A weight
is ``round(10^6 ln(frequency / total))`` as a whole number, so sums are exact.  A character that begins no word stands alone and weighs as a word
of frequency one.  Work is linear in the text, whatever the size of the dictionary.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIFT = 21  # bits of a character
_NO_WORD = np.iinfo(np.int64).min


class Dictionary(NamedTuple):
    """A frequency dictionary as a trie; made by :func:`dictionary`."""

    edges: np.ndarray
    nodes: np.ndarray
    weights: np.ndarray
    unknown: int
    longest: int

    def graph(self, text: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per word length 1, 2, ...: positions at which a word of that length begins, and its weight."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.arange(len(codes))
        node = np.zeros(len(codes), np.int64)
        found = []
        for length in range(1, self.longest + 1):
            inside = at + length <= len(codes)
            at, node = at[inside], node[inside]
            key = (node << _SHIFT) | codes[at + length - 1]
            edge = np.minimum(np.searchsorted(self.edges, key), max(len(self.edges) - 1, 0))
            known = self.edges[edge] == key if len(self.edges) else np.zeros(len(key), bool)
            at, node = at[known], self.nodes[edge[known]]
            weight = self.weights[node]
            ends = weight != _NO_WORD
            found.append((at[ends], weight[ends]))
            if not len(at):
                break
        return found

    def segment(self, texts: Iterable[str]) -> list[list[str]]:
        """Words of every text on the best route.  Texts are joined by a character no word holds, so routes never cross them."""
        texts = list(texts)
        whole = "\x00".join(texts)
        words: list[list[tuple[int, int]]] = [[] for _ in whole]
        for length, (at, weight) in enumerate(self.graph(whole), 1):
            for i, w in zip(at.tolist(), weight.tolist()):
                words[i].append((w, length))
        score = [0] * (len(whole) + 1)
        step = [1] * len(whole)
        for i in range(len(whole) - 1, -1, -1):
            best, length = (self.unknown + score[i + 1], 1)
            for w, n in words[i]:
                s = w + score[i + n]
                if s > best or (s == best and n > length):
                    best, length = s, n
            score[i], step[i] = best, length
        out, at = [], 0
        for t in texts:
            found, end = [], at + len(t)
            while at < end:
                found.append(whole[at : at + step[at]])
                at += step[at]
            out.append(found)
            at += 1
        return out


def weight_of(frequency: int, total: int) -> int:
    return round(1e6 * math.log(frequency / total))


def dictionary(words: Mapping[str, int] | Iterable[str]) -> Dictionary:
    """From words with frequencies, or words that are all equally frequent.  Empty words and words of frequency below one are left out."""
    given = dict(words) if isinstance(words, Mapping) else dict.fromkeys(words, 1)
    counts = {w: f for w, f in given.items() if w and f >= 1 and "\x00" not in w}
    total = max(sum(counts.values()), 1)
    if not counts:
        return Dictionary(np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(1, _NO_WORD), weight_of(1, total), 0)
    names = list(counts)
    sizes = np.array([len(w) for w in names])
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    node = np.zeros(len(names), np.int64)
    edges, nodes, n = [], [], 1
    # one level of the trie after the other: equal (node, character) pairs share their child
    for level in range(int(sizes.max())):
        alive = np.flatnonzero(sizes > level)
        key = (node[alive] << _SHIFT) | codes[start[alive] + level]
        unique, child = np.unique(key, return_inverse=True)
        node[alive] = child + n
        edges.append(unique)
        nodes.append(np.arange(len(unique)) + n)
        n += len(unique)
    weights = np.full(n, _NO_WORD)
    weights[node] = [weight_of(f, total) for f in counts.values()]
    keys, children = np.concatenate(edges), np.concatenate(nodes)
    order = np.argsort(keys)
    return Dictionary(keys[order], children[order], weights, weight_of(1, total), int(sizes.max()))


def read_dictionary(spark: SparkSession, path: str) -> Dictionary:
    """From a text file of lines ``word [frequency ...]``; a line without a number counts once.  The dictionary is one
    worker's data by definition: about 20 bytes a trie node."""
    parts = F.split(F.trim("value"), r"\s+")
    counted = F.coalesce(F.expr("try_cast(get(p, 1) AS bigint)"), F.lit(1))
    rows = spark.read.text(path).select(parts.alias("p")).select(F.get("p", F.lit(0)).alias("w"), counted.alias("f")).filter("w <> ''")
    return dictionary({r["w"]: r["f"] for r in rows.groupBy("w").agg(F.sum("f").alias("f")).toLocalIterator()})


def word_frequencies(tokens: DataFrame, least: int = 2) -> DataFrame:
    """(word, n) of a column ``tokens`` of word lists: what a dictionary can be learnt from."""
    return tokens.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def segmented(runs: Column, words: Dictionary, ideographs: str) -> Column:
    """``array<string>`` of runs to tokens: runs of ideographs are cut into words, the others stay.  Null stays null, so rows that need no
    dictionary cost next to nothing."""
    session = SparkSession.getActiveSession()
    shared = session.sparkContext.broadcast(tuple(words))
    first = _inside(ideographs)

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        d = Dictionary(*shared.value)
        for batch in batches:
            lists = [None if x is None else list(x) for x in batch]
            pieces = [r for x in lists if x is not None for r in x if first(r)]
            done = iter(d.segment(pieces))
            yield pd.Series([None if x is None else [w for r in x for w in (next(done) if first(r) else (r,))] for x in lists])

    return F.pandas_udf(cut, "array<string>")(runs)


def _inside(ideographs: str):
    pattern = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), ideographs) + "]")
    return lambda run: pattern.match(run) is not None
