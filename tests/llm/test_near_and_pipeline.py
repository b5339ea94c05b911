"""Near duplicates against all pairs, and the pipeline stage by stage."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pictorium.llm import near
from pictorium.llm.common import words_of


def shingle_set(text):
    w = words_of(text or "")
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def classes(rows):
    """Smallest id of every row's class, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(rows[i][0])
    return sorted(sorted(map(str, ids)) for ids in out.values())


def found(df):
    out = {}
    for r in df.collect():
        key = ("alone", id(r)) if r["class_id"] is None else r["class_id"]
        out.setdefault(key, []).append(str(r["doc_id"]))
        assert r["kept"] == (r["doc_id"] == r["class_id"])
    return sorted(sorted(ids) for ids in out.values())


def test_documents(spark, data, documents):
    from pictorium.llm.queries import QUERIES

    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert found(QUERIES["op10_near_duplicates"][0](spark, data)) == classes(rows)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("bands,block", [(None, near.BLOCK), ((2, 32), 3)])
def test_large_groups_and_common_passages(spark, bands, block):
    """Chains of edits, a large group, and many texts that share a passage but are different."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    base = [word() for _ in range(200)]
    texts += [edited(rng, base, rng.randrange(4)) for _ in range(40)]
    chain = [word() for _ in range(150)]
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = edited(rng, chain, 3).split()
    passage = [word() for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(60)]) for _ in range(60)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    texts += [texts[0]] * 30
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near.near_duplicates(docs, bands=bands, block=block)) == classes(rows)


def test_odd_rows(odd, none):
    got = near.near_duplicates(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == odd.count()
    assert (by[1]["class_id"], by[4]["class_id"], by[4]["kept"], by[1]["class_size"]) == (1, 1, False, 2)
    assert by[2]["kept"] and by[3]["kept"] and by[8]["kept"] and by[5]["class_size"] == 1
    assert by[7]["class_size"] == 2 and by[None]["kept"]
    kept = near.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in odd.collect() if r["doc_id"] != 4)
    assert near.near_duplicates(none).count() == 0 and near.drop_near_duplicates(none).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:260], rng.integers(0, 2**63, 40).astype(np.uint64)])
    wa, wb = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    weight = lambda k, w: dict(zip(k.tolist(), (1 + np.log(w)).tolist()))
    x, y = weight(a, wa), weight(b, wb)
    want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())
    salt = rng.integers(0, 2**63, 60).astype(np.uint64)
    equal = [np.equal(*near.signatures([a ^ s, b ^ s], [wa, wb])).mean() for s in salt]
    assert np.mean(equal) == pytest.approx(want, abs=0.03)
    one = near.signatures([a[:1]], [wa[:1]])
    assert (one == one[0, 0]).all()


def test_stages(spark, data, documents):
    from pictorium.llm import decontaminate, toxicity
    from pictorium.llm.common import table

    docs = documents
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, docs, data), "test")
        assert after.columns == documents.columns and after.schema == documents.schema
        before, kept = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (docs, after))
        assert set(kept) <= set(before)
        if name == "toxicity":
            model = toxicity.fit(docs, table(spark, data, "labels"))
            assert set(before) - set(kept) == {r["doc_id"] for r in toxicity.score_toxicity(docs, model).filter("predicted = 1").collect()}
        if name == "exact_dedup":
            last = {}
            for i, t in before.items():
                last[t] = max(i, last.get(t, i))
            assert set(kept) == set(last.values())
        if name == "near_dedup":
            assert sorted(kept) == sorted(min(map(int, c)) for c in classes(list(before.items())))
        if name == "decontamination":
            items = table(spark, data, "benchmark")
            dirty = {r["doc_id"] for r in decontaminate.contamination(docs, items).filter("contaminated").collect()}
            assert all(kept[i] == t for i, t in before.items() if i not in dirty)
            assert decontaminate.contamination(after, items).filter("contaminated").count() == 0
        docs = after
    pieces = corpus_pipeline.run(spark, data)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(kept)


def test_stages_on_odd_rows(spark, data, odd, none):
    """Nulls, empty and long texts, repeated rows and clashing column names pass every stage; so does an empty table."""
    docs, empty = odd, none
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, data), "odd")
        empty = corpus_pipeline.materialize(stage(spark, empty, data), "odd")
        assert empty.count() == 0
        if name != "packing":
            assert docs.columns == empty.columns == odd.columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        # one of the empty texts stays (the one with the largest id); the other texts are all different
        assert {4, 5, 6, 7, 9, 10, 11, None} <= ids
        assert (ids - {1, 2, 3, 8}) == {4, 5, 6, 7, 9, 10, 11, None}
    assert {8} == ids & {2, 3, 8}


def finder_labels(spark, sets, block):
    """Classes by the production bands of 64-bit sets that all weigh the same."""
    from pictorium.plans.scratch import Scratch

    signed = near.signatures(sets, [np.ones(len(s)) for s in sets])
    small = [np.sort((s >> np.uint64(32)).astype(np.uint32).view(np.int32)) for s in sets]
    rows = [(i, i, i, i, sig.tolist(), s.tolist()) for i, (sig, s) in enumerate(zip(signed, small))]
    prints = spark.createDataFrame(rows, "row long, doc_id long, mark long, node long, sig array<short>, set array<int>")
    labels = near._Finder(prints, Scratch(spark, "near-test"), 0.8, None, block).run()
    return {r["node"]: r["label"] for r in labels.collect()}


def test_pairs_in_a_group_of_alike_texts(spark):
    """150 pairs of similarity 0.82 among texts of one large group that are alike but below 0.8: the prefix
    join, in blocks of 3, loses none of them."""
    rng = np.random.default_rng(4)
    words = rng.integers(0, 2**63, 1000).astype(np.uint64)
    sets = []
    for _ in range(150):
        a = rng.choice(words, 850, replace=False)
        sets += [a, a[:700]]
    got = finder_labels(spark, sets, 3)
    assert got == {i: i - i % 2 for i in range(300)}


def test_repeated_passages_link_by_their_sets(spark):
    """40 pairs of set similarity 0.87 in which one text repeats a passage of its own 20 times."""
    rng = random.Random(7)
    rows = []
    for p in range(40):
        body = " ".join(f"a{p}x{rng.randrange(10**6)}" for _ in range(1004))
        rows.append((2 * p, body))
        rows.append((2 * p + 1, body + " " + " ".join(f"b{p}x{k % 146}" for k in range(146 * 20))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near.near_duplicates(docs)) == classes(rows)


def set_classes(sets, similarity=0.8):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_production_bands_with_sets_of_all_sizes(spark):
    """Sets of 40 to 90 elements, many pairs of them of similarity about 0.8, joined in blocks of 3."""
    rng = np.random.default_rng(11)
    sets = []
    for _ in range(6):
        base = rng.integers(0, 2**63, 90).astype(np.uint64)
        sets += [rng.choice(base, n, replace=False) for n in rng.integers(40, 91, 45)]
    want = set_classes([set((s >> np.uint64(32)).tolist()) for s in sets])
    assert 30 < len(set(want)) < 200
    got = finder_labels(spark, sets, 3)
    assert [got.get(i, i) for i in range(len(sets))] == want


def test_pairs_across_sizes_share_bands():
    """One process signs all sizes: pairs of similarity 0.8 and more meet, whatever their sizes."""
    rng = np.random.default_rng(6)
    size, n = near.bands_for(0.8)
    for a, b in ((8, 10), (50, 60), (60, 72), (63, 64), (63, 73), (100, 120), (700, 850)):
        big = [rng.integers(0, 2**63, b).astype(np.uint64) for _ in range(40)]
        small = [rng.permutation(x)[:a] for x in big]
        x, y = (near.signatures(s, [np.ones(len(e)) for e in s])[:, : size * n].reshape(40, n, size) for s in (big, small))
        assert (x == y).all(axis=2).any(axis=1).sum() >= 39


def test_prefix_join_leaves_few_pairs(spark):
    """600 texts of one group, each with 5 to 39 shingles of its own: every link is left, and no pair with a text that has more of its
    own than a similarity of 0.8 allows (an eighteenth of both sets together)."""
    from pictorium.plans.scratch import Scratch

    rng = np.random.default_rng(8)
    base = rng.integers(-(2**31), 2**31, 200).astype(np.int32)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: 200 - k], rng.integers(-(2**31), 2**31, k).astype(np.int32)])) for k in rng.integers(5, 40, 600)]
    links = {(i, j) for j in range(600) for i in range(j) if (c := len(np.intersect1d(sets[i], sets[j], True))) >= 0.8 * (len(sets[i]) + len(sets[j]) - c)}
    for block in (near.BLOCK, 70):
        finder = near._Finder(spark.createDataFrame([], "row long, node long, sig array<short>, set array<int>"), Scratch(spark, "near-test"), 0.8, None, block)
        finder.sets = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "node long, set array<int>")
        nodes = spark.createDataFrame([(i, i) for i in range(600)], "node long, cls long")
        pairs = finder.across(nodes).distinct()
        got = {tuple(r) for r in pairs.collect()}
        assert links <= got and all(a < b for a, b in got)
        own = [len(np.setdiff1d(s, base)) for s in sets]
        assert all(max(own[i], own[j]) <= (len(sets[i]) + len(sets[j])) / 18 for i, j in got)


def test_odd_sketches_leave_links_only(spark):
    """Sets of two halves that many share, and few shingles of their own: alike enough for the prefix join, not for a link."""
    from pictorium.plans.scratch import Scratch

    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(-(2**31), 2**31, n).astype(np.int32)
    common, halves = draw(60), [draw(30) for _ in range(24)]
    sets = [np.unique(np.concatenate([common, halves[i % 24], halves[(i // 24) % 24]])) for i in range(240)]
    sets += [np.unique(np.concatenate([s[3:], draw(2)])) for s in sets[:40]]
    links = {(i, j) for j in range(280) for i in range(j) if (c := len(np.intersect1d(sets[i], sets[j], True))) >= 0.8 * (len(sets[i]) + len(sets[j]) - c)}
    finder = near._Finder(spark.createDataFrame([], "row long, node long, sig array<short>, set array<int>"), Scratch(spark, "near-test"), 0.8, None, near.BLOCK)
    finder.sets = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "node long, set array<int>")
    odd = {r["node"]: np.array(r["odd"]) for r in near.odd_sketches(finder.sets).collect()}
    apart = lambda i, j: sum(int(x & (2**64 - 1)).bit_count() for x in (odd[i] ^ odd[j]).tolist())
    assert all(apart(i, j) <= len(np.setxor1d(sets[i], sets[j], True)) for i in range(0, 280, 7) for j in range(i))
    got = Counter(tuple(r) for r in finder.across(spark.createDataFrame([(i, i) for i in range(280)], "node long, cls long")).collect())
    assert links <= set(got) and len(links) >= 40 and len(got) <= 1.2 * len(links)


def test_arrivals_at_once_change_nothing():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 7, 40, 300)]
    counts = [rng.integers(1, 5, len(s)) for s in sets]
    for m in (64, 150):
        assert (near.signatures(sets, counts, m) == near.signatures(sets, counts, m, 13)).all()


def test_other_similarities(spark):
    rng = random.Random(4)
    rows = []
    for p in range(60):
        body = [f"a{p}x{rng.randrange(10**6)}" for _ in range(204)]
        rows += [(2 * p, " ".join(body[:150] + [f"b{k}x{rng.randrange(10**6)}" for k in range(4)])), (2 * p + 1, " ".join(body[:150] + [f"c{k}x{rng.randrange(10**6)}" for k in range(120)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    similar = sum(len(a & b) >= 0.5 * len(a | b) for a, b in ((shingle_set(rows[i][1]), shingle_set(rows[i + 1][1])) for i in range(0, 120, 2)))
    assert similar == 60 and near.near_duplicates(docs, similarity=0.5).filter("class_size = 2").count() == 120
    assert near.near_duplicates(docs).filter("class_size > 1").count() == 0
