"""Content hashes, bit fingerprints and Hamming distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import plain_tokens


def content_sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def similarity_to_hamming(percent: float | Column) -> Column:
    """Allowed bit distance for a similarity percentage."""
    percent = F.lit(float(percent)) if isinstance(percent, (int, float)) else percent
    return F.round(V.FINGERPRINT_BITS * (1 - percent / 100.0)).cast("int")


def resolve_distance(percent: float | None = None, distance: int | None = None) -> int:
    """Percent wins over an explicit distance, which wins over the default."""
    if percent is not None:
        return int(V.FINGERPRINT_BITS * (1.0 - percent / 100.0) + 0.5)
    return V.DEFAULT_DISTANCE if distance is None else distance


def _bits_to_hex(bits: Column) -> Column:
    """'0101…' (length a multiple of 8) to hex, 64 bits per step."""
    words = F.sequence(F.lit(0), ((F.length(bits) - 1) / 64).cast("int"))

    def one(i):
        part = F.substring(bits, i * 64 + 1, F.lit(64))
        return F.lpad(F.lower(F.conv(part, 2, 16)), F.floor(F.length(part) / 4).cast("int"), F.lit("0"))

    return F.array_join(F.transform(words, one), "")


def mean_threshold_hash(values: Column) -> Column:
    """Hex bits of ``x >= mean(x)``, first element first, zero-padded to whole
    bytes; an empty array gives eight zero bytes."""
    values = values.cast("array<double>")
    mean = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)
    flags = F.array_join(F.transform(values, lambda x: F.when(x >= mean, F.lit("1")).otherwise(F.lit("0"))), "")
    padded = F.rpad(flags, (F.ceil(F.size(values) / 8) * 8).cast("int"), F.lit("0"))
    return F.when(F.size(values) == 0, F.lit("0" * 16)).otherwise(_bits_to_hex(padded))


def token_fingerprint(text: Column) -> Column:
    """64-bit fingerprint of a text as a long.

    Tokens fall into 64 buckets by the low six bits of the first byte of their
    md5; bit ``i`` (first bucket = highest bit) says whether the bucket holds
    at least the mean number of tokens.  A token is spelled as two characters,
    A-D and a hex digit, which cannot match across a border, so a bucket counts
    half of what the string loses with them.  Each bucket is taken out of what
    the ones before it left over.
    """
    bytes_ = F.transform(plain_tokens(text), lambda t: F.substring(F.md5(t.cast("binary")), 1, 2))
    spelling = F.concat(F.lit(","), F.array_join(bytes_, ","))
    for letter, digits in zip("ABCD", ("048c", "159d", "26ae", "37bf")):
        spelling = F.regexp_replace(spelling, f",[{digits}]", letter)
    spelling = F.replace(spelling, F.lit(","), F.lit(""))
    names = F.array(*[F.lit(h + low) for h in "ABCD" for low in "0123456789abcdef"])

    def word(whole):
        total = F.length(whole)

        def step(acc, name):
            def taken(rest):
                # both lengths are twice the counts: the factors cancel
                enough = (F.length(acc["rest"]) - F.length(rest)) * 64 >= total
                bit = F.when(enough, F.lit(1)).otherwise(F.lit(0)).cast("long")
                return F.struct(F.shiftleft(acc["word"], 1).bitwiseOR(bit).alias("word"), rest.alias("rest"))

            return _bind(F.replace(acc["rest"], name, F.lit("")), taken)

        start = F.struct(F.lit(0).cast("long").alias("word"), whole.alias("rest"))
        return F.aggregate(names, start, step, lambda acc: acc["word"])

    return _bind(spelling, word)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def long_to_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def phash_to_long(phash: Column, on_bad: str = "error") -> Column:
    """First 16 hex digits as a signed long; bad hex raises or gives NULL."""
    head = F.substring(phash, 1, 16)
    bad = F.raise_error(F.concat(F.lit("not a hex fingerprint: "), phash)) if on_bad == "error" else F.lit(None)
    return F.when(
        phash.isNull() | head.rlike("^[0-9a-fA-F]+$"), F.conv(head, 16, -10).cast("long")
    ).otherwise(bad.cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column, on_bad: str = "error") -> Column:
    """Bit distance of two equal-length hex strings of any length."""
    whole = F.concat(a, b).rlike("^([0-9a-fA-F]{2})*$") & (F.length(a) == F.length(b)) & (F.length(a) % 2 == 0)
    words = F.sequence(F.lit(0), F.greatest((F.length(a) - 1) / 16, F.lit(0)).cast("int"))

    def step(acc, i):
        x = F.conv(F.substring(a, i * 16 + 1, F.lit(16)), 16, -10).cast("long")
        y = F.conv(F.substring(b, i * 16 + 1, F.lit(16)), 16, -10).cast("long")
        return acc + F.bit_count(F.coalesce(x, F.lit(0).cast("long")).bitwiseXOR(F.coalesce(y, F.lit(0).cast("long"))))

    distance = F.aggregate(words, F.lit(0), step)
    bad = F.raise_error(F.lit("hex fingerprints differ in length or are no hex")) if on_bad == "error" else F.lit(None)
    return F.when(whole, distance).otherwise(bad.cast("int"))
