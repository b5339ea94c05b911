"""Host-level quality rules with shrunken failure rates.

*Rules.*  Every document is measured once (words, characters in words, symbols, repeated lines, words in
repeated three-word windows) and judged by ``RULES``; ``short`` and ``repeats`` are the base rules, which decide alone.
*Hosts.*  Failures of every rule are added up by host (``source``), map-side first, so a host with a third of all
documents is a few partial sums.
*Shrinking.*  Rates of small hosts are noise.  The rates of one rule over all hosts are taken as draws of a beta
distribution whose mean and spread are estimated from the hosts themselves (moments of the beta-binomial: the pooled rate, and
the part ``rho`` of the variance between hosts that binomial noise does not explain).  A host's rate is its posterior mean
``(failures + mean * strength) / (documents + strength)`` with ``strength = (1 - rho) / rho``.
*Verdicts.*  A host is ``bad`` when the shrunken rate of some rule is above ``BAD`` and ``suspect`` above ``SUSPECT`` if that is
also ``TIMES`` the pooled rate; else ``good``.  Documents of a bad host go, of a suspect host those that fail any rule,
of a good host those that fail a base rule.

Measures are written once and read twice, so texts are scanned once; verdicts (one row per host) join them by host, hosts with very
many documents by broadcast.  Null text counts as empty and fails ``short``.  A document without a host is judged by its own
rules as if its host were good.  Rows repeat as they are.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pictorium.plans.scratch import Scratch
from pictorium.plans.skew import HOT_ROWS, lookup_join

from .common import row_batches, schema_plus, texts, with_columns

#: Rules as SQL over the measures: name -> condition of failing.  The first two decide alone.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "lengths": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}
BASE = ("short", "repeats")
BAD, SUSPECT, TIMES = 0.5, 0.25, 2.0
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


class Measures(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int


def measure(text: str) -> Measures:
    """Counts over one whole text.  Bytes split at ASCII white space only, which is what a word is here."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blanks = len(raw) - sum(map(len, words))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return Measures(len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    total = end = 0
    for i, w in enumerate(windows):
        if w in twice:
            total += i + 3 - max(end, i)
            end = i + 3
    return total


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, host and the measures of every row; one map stage."""
    docs = docs.select("doc_id", F.col("source").cast("string").alias("host"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            found = list(zip(*map(measure, texts(batch)))) or [[]] * len(MEASURES)
            yield with_columns(batch, ["doc_id", "host"], **{m: pa.array(x, pa.int64()) for m, x in zip(MEASURES, found)})

    return docs.mapInArrow(run, schema_plus(docs, ["doc_id", "host"], **{m: "long" for m in MEASURES}))


def failed(rule: str) -> Column:
    return F.expr(RULES[rule])


def host_failures(rows: DataFrame) -> DataFrame:
    """(host, n, f_<rule> ...): documents and failures of every host."""
    sums = [F.count_if(failed(r)).alias("f_" + r) for r in RULES]
    return rows.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), *sums)


class Prior(NamedTuple):
    mean: float
    strength: float


#: Limits of the share of variance between hosts; the least keeps the prior's strength finite.
RHO = (1e-6, 1.0)


def beta_prior(hosts: int, n: float, n2: float, f: float, f2n: float) -> Prior:
    """Prior of one rule from sums over hosts: their number, documents, squared documents, failures and
    ``failures ^ 2 / documents``."""
    if not n or f <= 0 or f >= n:
        return Prior(f / n if n else 0.0, 1 / RHO[0] - 1)
    mean = f / n
    spread = (f2n - n * mean * mean) / (mean * (1 - mean))
    free = n - n2 / n - (hosts - 1)
    rho = min(max((spread - (hosts - 1)) / free, RHO[0]), RHO[1]) if free > 0 else RHO[0]
    return Prior(mean, (1 - rho) / rho)


def priors(hosts: DataFrame) -> dict[str, Prior]:
    """Prior of every rule; one row of sums comes to the driver."""
    n = F.col("n").cast("double")
    sums = [F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("n2")]
    for r in RULES:
        f = F.col("f_" + r).cast("double")
        sums += [F.sum(f).alias("f_" + r), F.sum(f * f / n).alias("g_" + r)]
    row = hosts.agg(*sums).head()
    return {r: beta_prior(row["k"], row["n"] or 0.0, row["n2"] or 0.0, row["f_" + r] or 0.0, row["g_" + r] or 0.0) for r in RULES}


def host_verdicts(hosts: DataFrame, prior: dict[str, Prior]) -> DataFrame:
    """(host, n, r_<rule> ..., verdict) with the shrunken rates."""
    rated = hosts.select("host", "n", *[((F.col("f_" + r) + p.mean * p.strength) / (F.col("n") + p.strength)).alias("r_" + r) for r, p in prior.items()])
    bad, suspect = F.lit(False), F.lit(False)
    for r, p in prior.items():
        rate = F.col("r_" + r)
        bad = bad | (rate > BAD)
        suspect = suspect | ((rate > SUSPECT) & (rate > TIMES * p.mean))
    return rated.withColumn("verdict", F.when(bad, F.lit("bad")).when(suspect, F.lit("suspect")).otherwise(F.lit("good")))


def judge_hosts(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: doc_id, host, the measures, base_failed, kept, n_failed (rules) and host_verdict (null without a host)."""
    scratch = Scratch(docs.sparkSession, "hosts")
    rows, seen = scratch.write(measures(docs), n=F.count("host"))
    hosts, _ = scratch.write(host_failures(rows))
    verdicts, _ = scratch.write(host_verdicts(hosts, priors(hosts)).select("host", F.col("n").alias("host_n"), F.col("verdict").alias("host_verdict")))
    sizes = verdicts.select("host", F.col("host_n").alias("n"))
    known = lookup_join(rows.filter(F.col("host").isNotNull()), verdicts.drop("host_n"), ["host"], seen["n"], hot_rows, sizes)
    judged = known.unionByName(rows.filter(F.col("host").isNull()).withColumn("host_verdict", F.lit(None).cast("string")))
    any_failed = F.lit(0)
    for r in RULES:
        any_failed = any_failed + failed(r).cast("int")
    base = failed(BASE[0]) | failed(BASE[1])
    kept = ~base & ~F.coalesce(F.col("host_verdict") == "bad", F.lit(False)) & ~((any_failed > 0) & F.coalesce(F.col("host_verdict") == "suspect", F.lit(False)))
    return judged.select("doc_id", "host", *MEASURES, base.alias("base_failed"), kept.alias("kept"), any_failed.alias("n_failed"), "host_verdict")


def drop_failed(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The documents that are kept, unchanged.  Ids decide, so rows that share an id stay only if all are kept."""
    gone = judge_hosts(docs, hot_rows).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti").select(*docs.columns)


def oracle() -> str:
    """The same in plain SQL."""
    flags = ", ".join(f"CAST({cond} AS BOOLEAN) AS x_{r}" for r, cond in RULES.items())
    sums = ", ".join(f"CAST(count(*) FILTER (x_{r}) AS DOUBLE) AS f_{r}" for r in RULES)
    moments = ", ".join(f"sum(f_{r}) AS f_{r}, sum(f_{r} * f_{r} / n) AS g_{r}" for r in RULES)
    free = "(n - n2 / n - (k - 1))"
    share = ", ".join(
        f"f_{r} / n AS m_{r}, CASE WHEN f_{r} <= 0 OR f_{r} >= n OR {free} <= 0 THEN {RHO[0]!r} ELSE least(greatest("
        f"((g_{r} - n * (f_{r} / n) * (f_{r} / n)) / ((f_{r} / n) * (1 - f_{r} / n)) - (k - 1)) / {free}, {RHO[0]!r}), {RHO[1]!r}) END AS rho_{r}"
        for r in RULES
    )
    rates = ", ".join(f"(h.f_{r} + m_{r} * (1 - rho_{r}) / rho_{r}) / (h.n + (1 - rho_{r}) / rho_{r}) AS r_{r}, m_{r}" for r in RULES)
    bad = " OR ".join(f"r_{r} > {BAD}" for r in RULES)
    suspect = " OR ".join(f"(r_{r} > {SUSPECT} AND r_{r} > {TIMES} * m_{r})" for r in RULES)
    any_failed = " + ".join(f"CAST(x_{r} AS INTEGER)" for r in RULES)
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
    w AS (SELECT k, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    pos AS (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w),
    win AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS n FROM pos),
    rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY k),
    m AS (SELECT w.k, doc_id, host, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
      coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN rep ON rep.k = w.k),
    x AS (SELECT *, {flags} FROM m),
    h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, {sums} FROM x WHERE host IS NOT NULL GROUP BY host),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS k, sum(n) AS n, sum(n * n) AS n2, {moments} FROM h),
    p AS (SELECT {share} FROM s),
    r AS (SELECT h.host, {rates} FROM h, p),
    v AS (SELECT host, CASE WHEN {bad} THEN 'bad' WHEN {suspect} THEN 'suspect' ELSE 'good' END AS host_verdict FROM r)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, x_short OR x_repeats AS base_failed,
      NOT (x_short OR x_repeats) AND coalesce(host_verdict, 'good') <> 'bad' AND NOT (({any_failed}) > 0 AND coalesce(host_verdict, 'good') = 'suspect') AS kept,
      {any_failed} AS n_failed, host_verdict
    FROM x LEFT JOIN v ON v.host = x.host"""
