import math
import random
from collections import Counter

import numpy as np
import pytest

from oracle import compare, connect
from pictorium.llm import ranked
from pictorium.llm.common import words_of
from pictorium.llm.queries import QUERIES


def brute(docs, queries, k=10):
    bags = [(i, Counter(words_of(t or ""))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in queries:
        rows = []
        for i, b in bags:
            m = 100 - 75 + 75 * sum(b.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t in words_of(text or "") if b[t])
            if score > 0:
                rows.append((-score, i is None, i, score))
        out += [(item, r + 1, i, score) for r, (_, _, i, score) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def collection(n, seed, words=60):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    docs = [(i, " ".join(rng.choices(pool, weights, k=rng.choice([0, 1, 3, 20, 80])))) for i in range(n)]
    docs += [(n + i, docs[i][1]) for i in range(0, n, 3)]  # copies: ties
    return docs, [(q, " ".join(rng.choices(pool, k=rng.choice([1, 2, 6, 25])))) for q in range(15)]


@pytest.mark.parametrize("options", [{}, {"block": 2, "cells": 300}, {"block": 3, "cells": 2000, "most_terms": 7}, {"k": 1, "block": 1, "cells": 900}])
def test_equal_to_brute_force(spark, options):
    docs, queries = collection(300, 1)
    docs += [(None, docs[5][1]), (None, None), (7, "W1 w2. W3!"), (7, "W1 w2. W3!")]
    queries += [(3, "W1, w2 é"), (None, "w5 w5 w9"), (99, None), (98, "nowhere"), (3, "W1, w2 é")]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, rank int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in queries], "item_id long, text string, query int")
    rows = ranked.rank_documents(d, q, **options)
    assert sorted(map(tuple, rows.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute(docs, queries, options.get("k", 10))


def test_summaries_bound_and_skip():
    """Blocks hold the list, summaries are its maxima, and most of what cannot enter is not scored."""
    rng = np.random.default_rng(0)
    topic = rng.integers(0, 8, 2000)
    impacts = np.zeros((2000, 200), np.int32)
    for i in range(2000):
        own = topic[i] * 25 + rng.integers(0, 25, 12)
        impacts[i, own] = rng.integers(1, 1000, 12)
        impacts[i, rng.integers(0, 200, 3)] = rng.integers(1, 100, 3)
    piece = ranked.Piece(impacts, np.arange(2000), np.zeros(2000, bool), np.ones(200, np.int64), block=16)
    for t in range(200):
        parts, summary = piece.blocks(t)
        assert sorted(np.concatenate(parts)) == sorted(piece.postings(t))
        for p, s in zip(parts, summary):
            assert (impacts[p].max(axis=0) == s).all()
    for q in range(40):
        terms = np.unique(np.append(rng.integers(0, 8) * 25 + rng.integers(0, 25, 6), rng.integers(0, 200, 2)))
        query, best = ranked.Query(0, terms, rng.integers(1, 9, len(terms))), ranked.Best(10)
        piece.search(query, best)
        score = impacts[:, terms].astype(np.int64) @ query.weights
        assert best.id.tolist() == np.lexsort((np.arange(2000), -score))[:10].tolist()
    assert piece.skipped_blocks > 0.3 * piece.seen_blocks and piece.scored < 40 * 600


def test_sql(spark, data):
    problem, *_ = compare(spark, connect(data), data, *QUERIES["op12_ranked_search"])
    assert not problem


def test_odd_and_empty_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "quick brown fox"), (2, None)], "item_id long, text string")
    assert ranked.rank_documents(odd, items).count() == 2
    assert ranked.rank_documents(none, items).count() == 0 and ranked.rank_documents(odd, items.limit(0)).count() == 0
