"""Categories, tag/description consistency and grading as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _by_category(category: Column, table: dict[str, list[str]]) -> Column:
    chain = None
    for name, words in table.items():
        chain = F.when(category == name, _array(words)) if chain is None else chain.when(category == name, _array(words))
    return chain.otherwise(_array([]))


def normalize_category(raw: Column) -> Column:
    """Alias in either language to the canonical name; anything else: other."""
    chain = None
    for name, (aliases, _) in V.CATEGORIES.items():
        if aliases:
            hit = raw.isin(aliases)
            chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return chain.otherwise(F.lit("other"))


def category_display(category: Column) -> Column:
    chain = None
    for name, (_, display) in V.CATEGORIES.items():
        chain = F.when(category == name, F.lit(display)) if chain is None else chain.when(category == name, F.lit(display))
    return chain


def _any_in(words: Column, text: Column) -> Column:
    return F.exists(words, lambda w: F.contains(text, w))


def _one_or_none(condition: Column, message: Column) -> Column:
    return F.when(condition, F.array(message)).otherwise(_array([]))


def unexpected_tags(category: Column, tags: Column, strict: bool = True) -> Column:
    """Tags that hold no expected word and are not generic.  ``strict=False``
    accepts any tag for category other."""
    expected = _by_category(category, V.EXPECTED_TAG_WORDS)
    odd = F.filter(
        tags, lambda t: ~F.exists(expected, lambda w: F.contains(t, w)) & ~t.isin(V.GENERIC_TAGS)
    )
    return odd if strict else F.when(category == "other", _array([])).otherwise(odd)


def check_category_vs_tags(category: Column, tags: Column, strict: bool = True) -> Column:
    odd = unexpected_tags(category, tags, strict)
    head, tail = V.CONFLICT_TAGS_TEXT.format(category="\0", tags="").split("\0")
    message = F.concat(F.lit(head), category_display(category), F.lit(tail), F.array_join(odd, ", "))
    return _one_or_none(F.size(odd) > 0, message)


def check_category_vs_description(category: Column, description: Column) -> Column:
    text = F.lower(description)
    opposite = _by_category(category, V.OPPOSITE_WORDS)
    own = _any_in(_by_category(category, V.DESCRIPTION_WORDS), text)
    first, second, third = V.CONFLICT_DESCRIPTION_TEXT.format(category="\0", words="\0").split("\0")
    message = F.concat(
        F.lit(first), category_display(category), F.lit(second), F.array_join(opposite, " / "), F.lit(third)
    )
    return _one_or_none(~own & _any_in(opposite, text), message)


def check_tags_vs_description(tags: Column, description: Column) -> Column:
    text = F.lower(description)

    def unsupported(tag):
        chain = None
        for marker, family in V.TAG_FAMILIES:
            missing = ~_any_in(_array(family), text)
            hit = F.contains(tag, F.lit(marker))
            chain = F.when(hit, missing) if chain is None else chain.when(hit, missing)
        return chain.otherwise(F.lit(False))

    head, tail = V.CONFLICT_SUPPORT_TEXT.format(tag="\0").split("\0")
    messages = F.transform(F.filter(tags, unsupported), lambda t: F.concat(F.lit(head), t, F.lit(tail)))
    return F.when(description.rlike(r"\S"), messages).otherwise(_array([]))


def check_all(category: Column, tags: Column, description: Column, strict: bool = True) -> Column:
    return F.concat(
        check_category_vs_tags(category, tags, strict),
        check_category_vs_description(category, description),
        check_tags_vs_description(tags, description),
    )


def grade_by_confidence(confidence: Column) -> Column:
    return (
        F.when(confidence >= V.VERIFIED_FROM, F.lit("verified"))
        .when(confidence >= V.PROVISIONAL_FROM, F.lit("provisional"))
        .otherwise(F.lit("rejected"))
    )


def grade(category: Column, confidence: Column, tags: Column, description: Column, strict: bool = True) -> Column:
    """verified / provisional / rejected; any conflict rejects."""
    conflicts = check_all(normalize_category(category), tags, description, strict)
    return F.when(F.size(conflicts) > 0, F.lit("rejected")).otherwise(grade_by_confidence(confidence))


def derive_is_correct(tag_status: Column, confidence: Column) -> Column:
    return (
        F.when(tag_status == "verified", F.lit(True))
        .when(tag_status == "rejected", F.lit(False))
        .otherwise(confidence >= V.CORRECT_FROM)
    )
