"""Person, place and time mentions in Chinese narratives (regex, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

_TIMES = "|".join(V.TIME_WORDS)
_SUFFIXES = "|".join(V.PLACE_SUFFIXES)


def extract_persons(text: Column, max_len: int = 1) -> Column:
    """Name after 和/与/跟: distinct, all of one prefix before the next.
    ``max_len`` > 1 takes longer names greedily."""
    found = [
        F.regexp_extract_all(text, F.lit(f"{p}(?=([{V.CJK}]{{1,{max_len}}}))"), F.lit(1))
        for p in V.PERSON_PREFIXES
    ]
    return F.array_distinct(F.concat(*found))


def extract_places(text: Column, max_len: int = 1) -> Column:
    """Place after 在/去/到/从, unless a time word starts there.  With
    ``max_len`` > 1 the place runs up to a known suffix or the end of the
    ideographs."""
    if max_len == 1:
        body = f"(?=([{V.CJK}]))"
    else:
        body = f"(?=([{V.CJK}]{{1,{max_len}}}?)(?:{_SUFFIXES}|[^{V.CJK}]|\\z))"
    found = [
        F.regexp_extract_all(text, F.lit(f"(?!{_TIMES}){p}(?!{_TIMES}){body}"), F.lit(1))
        for p in V.PLACE_PREFIXES
    ]
    return F.array_distinct(F.concat(*found))


def extract_times(text: Column) -> Column:
    """Known time words, then the weekday at the first 周 and first 星期."""
    words = F.filter(F.array(*[F.lit(w) for w in V.TIME_WORDS]), lambda w: F.contains(text, w))
    days = []
    for prefix in V.WEEK_PREFIXES:
        at = F.instr(text, prefix)
        word = F.substring(text, at, F.lit(len(prefix) + 1))
        good = (at > 0) & F.substring(word, len(prefix) + 1, 1).isin(V.WEEK_DAYS)
        days.append(F.when(good, F.array(word)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(words, *days))


def extract_entities(text: Column, max_len: int = 1) -> Column:
    """``array<struct<type,value>>``: persons, then places, then times."""

    def tagged(kind, values):
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    return F.concat(
        tagged("person", extract_persons(text, max_len)),
        tagged("place", extract_places(text, max_len)),
        tagged("time", extract_times(text)),
    )
