"""Tokenising and text predicates, all JVM-side."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as V
from .segment import Dictionary, segmented

_STOP = list(dict.fromkeys(V.STOP_WORDS))


def default_words() -> list[str]:
    """Multi-character CJK words the rule tables already know."""
    words: set[str] = set()
    for table in (V.EXPECTED_TAG_WORDS, V.DESCRIPTION_WORDS, V.OPPOSITE_WORDS):
        for entries in table.values():
            words.update(entries)
    for aliases, display in V.CATEGORIES.values():
        words.update([*aliases, display])
    words.update(V.GENERIC_TAGS)
    words.update(V.TIME_WORDS)
    words.update(V.PLACE_SUFFIXES)
    words.update(V.STOP_WORDS)
    for _, family in V.TAG_FAMILIES:
        words.update(family)
    return sorted(w for w in words if len(w) > 1 and not w.isascii())


def _token_pattern(words: Iterable[str], unknown: str) -> str:
    """Runs of letters and digits other than ideographs; else the longest
    dictionary word; else a single ideograph (or a pair).  Java alternation is
    ordered, so this is a forward maximum match without a Python worker."""
    ordered = sorted(set(words), key=lambda w: (-len(w), w))
    parts = [rf"[\p{{L}}\p{{N}}&&[^{V.CJK}]]+", *[re.escape(w) for w in ordered]]
    if unknown == "pair":
        parts.append(f"[{V.CJK}]{{2}}")
    parts.append(f"[{V.CJK}]")
    return "|".join(parts)


def tokenize(text: Column, words: Dictionary | Iterable[str] | None = None, unknown: str = "char") -> Column:
    """``array<string>`` of search tokens.

    Drops empty tokens, tokens of one byte, and stop words.  ``words`` is the
    CJK dictionary.  A :class:`Dictionary` of any size segments runs of ideographs by the best route through
    their word graph; only those runs leave the JVM.  A short plain list is matched longest first inside one regular expression;
    characters outside it come out singly (``unknown="char"``) or as pairs (``unknown="pair"``).
    """
    low = F.lower(text)
    if isinstance(words, Dictionary):
        with_ideographs = low.rlike(f"[{V.CJK}]")
        runs = F.regexp_extract_all(low, F.lit(rf"[{V.CJK}]+|[\p{{L}}\p{{N}}&&[^{V.CJK}]]+"), F.lit(0))
        cut = segmented(F.when(with_ideographs, runs), words, V.CJK)
        return _searchable(F.when(with_ideographs, cut).otherwise(plain_tokens(text)))
    pattern = _token_pattern(default_words() if words is None else words, unknown)
    # the plain pattern is four times faster and equal on texts without ideographs
    mixed = F.regexp_extract_all(low, F.lit(pattern), F.lit(0))
    found = F.when(low.rlike(f"[{V.CJK}]"), mixed).otherwise(plain_tokens(text))
    return _searchable(found)


def _searchable(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: (F.octet_length(t) > 1) & ~t.isin(_STOP))


def plain_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, nothing dropped."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_tokens(spark: SparkSession, query: str, words: Dictionary | Iterable[str] | None = None) -> list[str]:
    """Tokens of one query string.  Without a :class:`Dictionary` folded by the optimizer, with no job."""
    row = spark.sql("SELECT 1 AS one").select(tokenize(F.lit(query), words).alias("t")).head()
    return list(dict.fromkeys(row["t"]))


def contains_ci(column: Column, needle: str | Column) -> Column:
    """Case-insensitive literal containment: what ``LIKE '%needle%'`` with an
    escaped needle does, so wildcards need no escaping here."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(column), F.lower(needle))


def json_strings(column: Column) -> Column:
    """JSON text to ``array<string>``; anything unparsable gives ``[]``."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


def json_strings_or_raw(column: Column) -> Column:
    """Like :func:`json_strings`, but text that is no JSON list is one tag."""
    parsed = F.from_json(column, "array<string>")
    bracketed = F.trim(column).startswith("[")
    return F.when(bracketed & parsed.isNotNull(), parsed).otherwise(F.array(column))


def csv_escape(column: Column) -> Column:
    """Quote a field only when it holds a quote, comma, CR or LF."""
    quoted = F.concat(F.lit('"'), F.replace(column, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(column.rlike('[",\r\n]'), quoted).otherwise(column)


def base_name(path: Column) -> Column:
    """Last path component for either separator."""
    return F.element_at(F.split(path, r"[\\/]"), -1)
