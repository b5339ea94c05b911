import random

import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from pictorium.llm import hosts
from pictorium.llm.queries import QUERIES


def brute(text):
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip("\t\n\x0b\x0c\r ")]
    again = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(hit), len(lines)


def test_measures_equal_brute_force():
    rng = random.Random(5)
    pool = ["a", "b", "é", " ", "　x", "#|", "\n", "\n", "\t", "\x0b", "\x1f"]
    for _ in range(300):
        t = "".join(rng.choice(pool) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 40)))
        assert tuple(hosts.measure(t)) == brute(t)
    assert hosts.measure("a a a a") == (4, 4, 0, 0, 4, 1)


def test_sql(spark, data):
    problem, *_ = compare(spark, connect(data), data, *QUERIES["op11_host_rules"])
    assert not problem


def test_prior_finds_the_spread_of_the_hosts():
    rng = random.Random(1)
    n, fails = 400, []
    for _ in range(300):
        p = rng.betavariate(2, 6)
        fails.append(sum(rng.random() < p for _ in range(n)))
    prior = hosts.beta_prior(300, 300.0 * n, 300.0 * n * n, sum(fails), sum(f * f / n for f in fails))
    assert prior.mean == pytest.approx(0.25, abs=0.02) and prior.strength == pytest.approx(8, rel=0.25)
    # hosts that differ by chance alone are shrunk onto the pooled rate
    flat = [sum(rng.random() < 0.25 for _ in range(n)) for _ in range(300)]
    assert hosts.beta_prior(300, 300.0 * n, 300.0 * n * n, sum(flat), sum(f * f / n for f in flat)).strength > 300
    for edge in ((1, 5.0, 25.0, 2.0, 0.8), (0, 0.0, 0.0, 0.0, 0.0), (2, 9.0, 41.0, 9.0, 9.0), (3, 3.0, 3.0, 1.0, 1.0)):
        assert hosts.beta_prior(*edge).strength >= 0


GOOD = " ".join(f"word{i}" for i in range(60))
NOISY = GOOD + " #|#|#|#|"


def verdict_rows(spark):
    rows = [(i, GOOD, f"h{i % 20}") for i in range(400)]
    rows += [(1000 + i, "too short", "bad") for i in range(30)] + [(1100, GOOD, "bad")]
    rows += [(2000 + i, NOISY if i % 3 == 0 else GOOD, "suspect") for i in range(60)]
    rows += [(3000, "too short", "tiny"), (3001, GOOD, None), (3002, NOISY, None), (3003, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_verdicts(spark, hot_rows):
    docs = verdict_rows(spark)
    rows = {r["doc_id"]: r for r in hosts.judge_hosts(docs, hot_rows).collect()}
    assert len(rows) == docs.count()
    assert rows[1100]["host_verdict"] == "bad" and not rows[1100]["kept"] and not rows[1100]["base_failed"]
    assert rows[2000]["host_verdict"] == "suspect" and not rows[2000]["kept"] and rows[2001]["kept"]
    # one failure of one document is shrunk
    assert rows[3000]["base_failed"] and not rows[3000]["kept"]
    assert rows[3001]["kept"] and rows[3002]["kept"] and rows[3001]["host_verdict"] is None and not rows[3003]["kept"]
    assert {r["doc_id"] for r in hosts.drop_failed(docs, hot_rows).collect()} == {i for i, r in rows.items() if r["kept"]}


def test_odd_rows(spark, odd, none):
    docs = odd.withColumn("source", F.lit("s")).withColumn("n_words", F.lit(7)).withColumn("host", F.lit(7))
    assert hosts.judge_hosts(docs).count() == docs.count()
    long = hosts.judge_hosts(docs).filter("doc_id = 11").head()
    assert long["n_words"] == 30_000 and long["n_repeat_words"] == 30_000 and not long["kept"]
    empty = docs.limit(0)
    assert hosts.judge_hosts(empty).count() == 0 and hosts.drop_failed(empty).columns == docs.columns
