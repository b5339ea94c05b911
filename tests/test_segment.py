"""Dictionary segmentation against all segmentations of short texts, and its work on large dictionaries."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pictorium.checks.search import CHINESE_WORDS
from pictorium.functions import segment, text

SMALL = {"可爱": 200, "小猫": 150, "猫": 300, "草地": 120, "地上": 90, "上": 200, "草": 80, "玩耍": 60, "一只": 400, "这是": 500, "非常": 300, "美丽": 200, "风景": 250, "南京": 100, "南京市": 80, "市长": 90, "长江": 120, "大桥": 110, "长江大桥": 60, "江": 50}


def brute(t, counts):
    """The best of all segmentations; at every position the longer word wins a tie."""
    total = sum(counts.values())

    def routes(i):
        if i == len(t):
            return [(0, ())]
        out = []
        for n in range(1, len(t) - i + 1):
            w = t[i : i + n]
            if n == 1 or w in counts:
                weight = segment.weight_of(counts.get(w, 1), total)
                out += [(weight + s, (n, *rest)) for s, rest in routes(i + n)]
        return out

    best, at, out = max(routes(0)), 0, []
    for n in best[1]:
        out.append(t[at : at + n])
        at += n
    return out


def test_best_route_equals_all_segmentations():
    rng = random.Random(8)
    letters = "甲乙丙丁"
    for _ in range(40):
        counts = {"".join(rng.choices(letters, k=rng.randint(1, 4))): rng.randint(1, 30) for _ in range(15)}
        d = segment.dictionary(counts)
        texts = ["".join(rng.choices(letters + "戊", k=rng.randint(0, 9))) for _ in range(20)]
        assert d.segment(texts) == [brute(t, counts) for t in texts]


def test_known_sentences():
    d = segment.dictionary(SMALL)
    assert d.segment(["这是一只可爱的小猫在草地上玩耍"]) == [["这是", "一只", "可爱", "的", "小猫", "在", "草地", "上", "玩耍"]]
    assert d.segment(["南京市长江大桥"])[0] == brute("南京市长江大桥", SMALL)
    assert segment.dictionary({}).segment(["风景", ""]) == [["风", "景"], []]
    assert segment.dictionary(["风景", "景色"]).segment(["风景色"]) == [["风", "景色"]] or segment.dictionary(["风景", "景色"]).segment(["风景色"]) == [["风景", "色"]]


def test_tokens(spark):
    d = segment.dictionary(SMALL)
    rows = spark.createDataFrame([("这是一只可爱的小猫 ABC12 在草地上玩耍",), ("No ideographs, the plain PATH é",), (None,), ("",), ("…！",)], "t string")
    got = [r[0] for r in rows.select(text.tokenize(F.col("t"), d)).collect()]
    assert got == [["这是", "一只", "可爱", "小猫", "abc12", "草地", "玩耍"], ["ideographs", "plain", "path", "é"], None, [], []]
    assert text.query_tokens(spark, "可爱小猫 Cat", d) == ["可爱", "小猫", "cat"]
    only_runs = rows.select(text.tokenize(F.col("t"), d))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in only_runs and "ArrowEvalPython" in only_runs


def test_read_dictionary(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("可爱 200 a\n小猫 150\n\n小猫 50\n单独\n坏 x\n", encoding="utf-8")
    got = segment.read_dictionary(spark, str(path))
    want = segment.dictionary({"可爱": 200, "小猫": 200, "单独": 1, "坏": 1})
    assert sorted(got.edges.tolist()) == sorted(want.edges.tolist()) and got.unknown == want.unknown
    assert got.segment(["可爱小猫单独"]) == [["可爱", "小猫", "单独"]]


def large(n, rng):
    return {"".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.choice([1, 2, 2, 2, 3, 4]))): rng.randint(1, 5000) for _ in range(n)}


def test_large_dictionaries():
    """Work grows with the text, not with the dictionary of 300,000 words."""
    rng = random.Random(2)
    small, big = large(3_000, rng), large(300_000, rng)
    words = list(big)
    t = "".join(rng.choices(words, k=20_000))
    taken = {}
    for name, counts in (("small", small), ("big", big)):
        d = segment.dictionary(counts)
        for k in (1, 4):
            start = time.perf_counter()
            out = d.segment([t[: len(t) * k // 4]])
            taken[name, k] = time.perf_counter() - start
            assert "".join(out[0]) == t[: len(t) * k // 4]
    assert taken["big", 4] < 8 * taken["big", 1] + 0.2 and taken["big", 4] < 8 * taken["small", 4] + 0.2


def test_words_learnt_from_the_corpus_find_their_boundaries(spark, documents):
    """Texts without their spaces, segmented by the words of the corpus: nearly all words come back."""
    tokens = documents.select(text.plain_tokens(F.col("text")).alias("tokens"))
    counts = {r["word"]: r["n"] for r in segment.word_frequencies(tokens, 1).collect()}
    d = segment.dictionary(counts)
    rows = [r["tokens"] for r in tokens.limit(40).collect()]
    found = d.segment("".join(r) for r in rows)
    right = total = 0
    for want, got in zip(rows, found):
        assert "".join(want) == "".join(got)
        ends = lambda ws: {sum(map(len, ws[: i + 1])) for i in range(len(ws))}
        right += len(ends(want) & ends(got))
        total += len(want)
    assert right / total > 0.8


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_query_dictionary_has_overlaps():
    assert {"北京", "去年", "公园"} <= set(CHINESE_WORDS)
