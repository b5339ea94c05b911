"""Licence notices: fixed phrases, and an exact set-similarity join with templates.

DataFrame operations only; one scan for the token frequencies and one for the result.

*Phrases.*  A document is looked at word by word only if the phrase occurs in it
at all (one regular expression).  *Templates.*  A block matches a
template when it holds at least ``threshold`` of the template's distinct words.  Blocks are the lines of a document and, for notices that are
wrapped over lines, windows of ``WINDOW`` words at every ``STRIDE`` words: any run of ``WINDOW - STRIDE + 1`` words lies in one of them, and
templates are shorter.  The join follows the usual filters of exact set-similarity joins:

* template words are ranked by their document frequency over the whole corpus, rarest first;
* prefix filter: a match needs ``need = ceil(threshold * |T|)`` common words, so it shares one of
  the ``|T| - need + 1`` rarest words of the template; only those are posted, and a block without any is never split into words;
* length filter: the block holds at least ``need`` words that any template uses;
* positional filter: with the common word at ranks i and j, no more than
  ``min(i, j) + 1 + min(|T| - i - 1, |B| - j - 1)`` words can be common;
* what is left is verified by intersection.

Template postings are broadcast; their size is that of the given templates, not of the data.  A
document's rows meet again by a row number of its own, so repeated ids stay apart.

Null and empty texts have no words, null positions, empty labels and score 0.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import single

# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices looked for by similarity: label -> text.
TEMPLATES = {
    "notice-gpl": "this work is licensed under the gnu general public license version 3",
    "notice-apache": "licensed under the apache license version 2 0",
    "notice-cc-by-nc": "licensed under cc by nc 4 0",
    "notice-mit": "released under the mit license",
    "terms-mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "terms-bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "terms-reserved": "copyright all rights reserved no part may be reproduced without permission",
}
THRESHOLD = 0.9
#: Words of a window and between the starts of two.
WINDOW, STRIDE = 64, 32

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, before A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, BREAK), lambda w: w != "")


def word_count(text: Column) -> Column:
    parts = F.split(text, BREAK)
    blank = (F.get(parts, F.lit(0)) == "").cast("int") + ((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == "")).cast("int")
    return (F.size(parts) - blank).cast("long")


def phrase_places(text: Column, phrases=PHRASES) -> Column:
    """Array of (start, label) for every place of every phrase."""
    words = word_array(lower_ascii(text))

    def starts(phrase: str, label: str) -> Column:
        want = phrase.split()

        def hit(w, i):
            ok = w == want[0]
            for k, x in enumerate(want[1:], 1):
                ok = ok & F.coalesce(F.get(words, i + k) == x, F.lit(False))
            return F.when(ok, F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

        return F.array_compact(F.transform(words, hit))

    any_phrase = "|".join(BREAK.join(p.split()) for p, _ in phrases)
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    return F.when(text.rlike(f"(?i)(?:{any_phrase})"), F.concat(*[starts(p, label) for p, label in phrases])).otherwise(none)


def word_windows(low: Column) -> Column:
    """Windows of words as texts; the words are split once."""
    words = F.filter(F.split(low, BREAK), lambda w: w != "")

    def cut(ws):
        starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0)), F.lit(STRIDE))
        return F.transform(starts, lambda i: F.array_join(F.slice(ws, i + 1, WINDOW), " "))

    return F.get(F.transform(F.array(words), cut), F.lit(0))


def template_ranks(docs: DataFrame, templates: dict[str, str]) -> dict[str, int]:
    """Rank of every template word, rarest in the corpus first (ties by the word)."""
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), BREAK)
    known = F.array(*[F.lit(w) for w in vocabulary])
    counted = docs.select(F.explode(F.array_intersect(words, known)).alias("w")).groupBy("w").count()
    n = {r["w"]: r["count"] for r in counted.collect()}  # at most one row per template word
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}


def postings(docs: DataFrame, ranks: dict[str, int], templates: dict[str, str], threshold: float) -> tuple[DataFrame, list[str]]:
    """(rank, label, i, need, members) for the prefix words, and those words."""
    word = {r: w for w, r in ranks.items()}
    rows, prefix = [], set()
    for label, text in templates.items():
        members = sorted(ranks[w] for w in set(text.split()))
        need = math.ceil(threshold * len(members) - 1e-9)
        for i, r in enumerate(members[: len(members) - need + 1]):
            rows.append((r, label, i, need, members))
            prefix.add(word[r])
    frame = docs.sparkSession.createDataFrame(rows, "rank int, label string, i int, need int, members array<int>")
    return frame, sorted(prefix)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (largest containment, 1 with a phrase)."""
    docs = single(docs)
    ranks = template_ranks(docs, templates)
    posted, prefix = postings(docs, ranks, templates, threshold)
    vocabulary = F.create_map(*[x for w, r in ranks.items() for x in (F.lit(w), F.lit(r))])
    has_prefix = lambda c: F.greatest(*[F.contains(c, F.lit(w)) for w in prefix], F.lit(False))

    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    blocks = F.concat(F.split(low, r"\n"), word_windows(low))
    lines = F.when(has_prefix(low), F.filter(blocks, has_prefix)).otherwise(F.array().cast("array<string>"))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        word_count(text).alias("n_words"),
        phrase_places(text, phrases).alias("places"),
        F.array_distinct(lines).alias("lines"),
    )
    rows = rows.select("row", "doc_id", "n_words", "places", F.explode_outer("lines").alias("line"))
    in_line = F.array_compact(F.transform(F.array_distinct(F.split("line", BREAK)), lambda w: F.try_element_at(vocabulary, w)))
    rows = rows.select("row", "doc_id", "n_words", "places", F.array_sort(in_line).alias("block"))
    rows = rows.select("row", "doc_id", "n_words", "places", "block", F.posexplode_outer("block").alias("j", "rank"))
    t_rest, b_rest = F.size("members") - F.col("i") - 1, F.size("block") - F.col("j") - 1
    possible = (F.size("block") >= F.col("need")) & (F.least("i", "j") + 1 + F.least(t_rest, b_rest) >= F.col("need"))
    pairs = rows.join(F.broadcast(posted), (rows["rank"] == posted["rank"]) & possible, "left")
    common = F.size(F.array_intersect("block", "members"))
    share = F.when(common >= F.col("need"), common / F.size("members"))
    pairs = pairs.select("row", "doc_id", "n_words", "places", "label", share.alias("share"))
    found = pairs.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.first("places").alias("places"),
        F.collect_set(F.when(F.col("share").isNotNull(), F.col("label"))).alias("similar"),
        F.max("share").alias("share"),
    )
    base = F.array_distinct(F.col("places.label"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.col("places.start")).alias("first_word"),
        F.array_max(F.col("places.start")).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, "similar")), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> str:
    """Plain SQL for :func:`scan_licenses`: every line and window against every template."""
    def quoted(values):
        return ", ".join("'" + v + "'" for v in values)

    hits = []
    for phrase, label in phrases:
        want = phrase.split()
        test = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(want))
        hits.append(f"list_transform(list_filter(range(0, len(w)), lambda i: {test}), lambda i: {{'start': i, 'label': '{label}'}})")
    places = hits[0]
    for h in hits[1:]:
        places = f"list_concat({places}, {h})"
    members = {k: sorted(set(t.split())) for k, t in templates.items()}
    share = {
        k: f"list_max(list_transform(lines, lambda l: len(list_intersect(list_distinct(regexp_split_to_array(l, '{BREAK}')), [{quoted(m)}]))))"
        for k, m in members.items()
    }
    need = {k: math.ceil(threshold * len(m) - 1e-9) for k, m in members.items()}
    similar = ", ".join(f"CASE WHEN {share[k]} >= {need[k]} THEN {share[k]} / CAST({len(members[k])} AS DOUBLE) END AS s{i}" for i, k in enumerate(members))
    names = list(members)
    labels = ", ".join(f"CASE WHEN s{i} IS NOT NULL THEN '{k}' END" for i, k in enumerate(names))
    scores = ", ".join(f"coalesce(s{i}, 0.0)" for i in range(len(names)))
    return rf"""
    WITH split AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
        string_split(lower(coalesce(text, '')), chr(10)) AS own, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{BREAK}'), lambda x: x <> '') AS v FROM documents),
    blocks AS (SELECT doc_id, w, list_concat(own, list_transform(range(0, greatest(len(v), 1), {STRIDE}), lambda i: array_to_string(v[i + 1:i + {WINDOW}], ' '))) AS lines FROM split),
    placed AS (SELECT doc_id, len(w) AS n_words, {places} AS places, {similar} FROM blocks),
    named AS (SELECT *, list_distinct(list_transform(places, lambda p: p.label)) AS base,
      list_filter([{labels}], lambda x: x IS NOT NULL) AS more, list_transform(places, lambda p: p.start) AS starts FROM placed)
    SELECT doc_id, n_words, len(places) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word,
      coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(base, more))), ','), '') AS labels,
      CASE WHEN len(places) > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(greatest({scores}) AS DOUBLE) END AS score
    FROM named
    """
