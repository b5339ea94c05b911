"""Substring search by an index of character trigrams, verified exactly.

*Grams.*  Every position of a lower-cased text starts a gram of ``GRAM`` characters (the end is padded), so a needle of that length or more is held
only by texts that hold all its grams, and a shorter needle begins one of their grams.
*Storage.*  A row holds the ids of one gram in one bucket of neighbouring ids, so no gram's list is one row or one task's group; rows are sorted by
gram in small row groups.  New texts are appended; changed or deleted texts need no upkeep, as candidates are verified on the current rows.
*Choice.*  Of a needle's grams the ``CHOSEN`` rarest are read, by the frequencies the index knows, and ids that have all of them are the candidates.
Short needles read the grams they begin.
*Verification.*  The caller's own predicate decides on the candidates' rows; a short list of ids is pushed to their scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.plans.scratch import Scratch

GRAM = 3
#: Grams of a needle that are read.
CHOSEN = 3
#: Ids of a bucket: 2^BITS.
BITS = 12
PAD = "\x01"
#: Candidates whose ids are pushed to the scan one by one.
MAX_PUSHED = 1_000
ROW_GROUP_BYTES = 8 << 20


def grams(text: Column) -> Column:
    """Distinct grams of a text; one starts at every character.  The characters are bound once, so the work is linear in the text."""
    cut = F.split(F.concat(F.lower(text), F.lit(PAD * (GRAM - 1))), "")

    def of(chars: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(chars) - GRAM)
        return F.array_distinct(F.transform(at, lambda i: F.concat(*[F.get(chars, i + k) for k in range(GRAM)])))

    none = F.array().cast("array<string>")
    return F.when(F.length(text) > 0, F.get(F.transform(F.array(cut), of), F.lit(0))).otherwise(none)


def append_texts(texts: DataFrame, path: str, bits: int = BITS) -> None:
    """Adds ``texts(id, text)`` to the index."""
    rows = texts.filter(F.col("id").isNotNull()).select("id", F.explode(grams(F.col("text"))).alias("gram"))
    keyed = rows.withColumn("bucket", F.shiftright("id", bits))
    lists = keyed.groupBy("gram", "bucket").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    blocks, _ = Scratch(texts.sparkSession, "grams").write(lists.select("gram", "bucket", F.size("ids").alias("n"), "ids"))
    dealt = blocks.repartitionByRange("gram", "bucket").sortWithinPartitions("gram", "bucket")
    dealt.write.mode("append").option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)


def needle_grams(needle: str) -> list[str]:
    return list(dict.fromkeys(needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)))


def candidates(spark: SparkSession, path: str, needle: str, chosen: int = CHOSEN) -> DataFrame:
    """``(id)`` of all texts that can hold the needle, and few others."""
    low = spark.range(1).select(F.lower(F.lit(needle))).head()[0]
    blocks = spark.read.parquet(path)
    if len(low) < GRAM:
        begun = blocks.filter(F.col("gram").startswith(low)) if low else blocks
        return begun.select(F.explode("ids").alias("id")).distinct()
    asked = needle_grams(low)
    known = {r["gram"]: r["n"] for r in blocks.filter(F.col("gram").isin(asked)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    if len(known) < len(asked):  # a gram no text has
        return blocks.limit(0).select(F.explode("ids").alias("id"))
    rarest = sorted(asked, key=lambda g: (known[g], g))[:chosen]
    lists = blocks.filter(F.col("gram").isin(rarest))
    # buckets first: one that lacks a gram has no candidate
    full = lists.groupBy("bucket").agg(F.count_distinct("gram").alias("k")).filter(F.col("k") == len(rarest)).select("bucket")
    rows = lists.join(full, "bucket", "left_semi").select("gram", F.explode("ids").alias("id"))
    return rows.groupBy("id").agg(F.count_distinct("gram").alias("k")).filter(F.col("k") == len(rarest)).select("id")


def find_containing(rows: DataFrame, path: str, needles: Iterable[str], predicate: Column, key: str = "id", trace: list[int] | None = None) -> DataFrame:
    """Rows that meet ``predicate``, which may hold only where an indexed text contains one of the needles.  ``trace`` gets the
    number of rows verified."""
    spark = rows.sparkSession
    found = [candidates(spark, path, n) for n in needles]
    if not found:
        return rows.limit(0)
    ids = reduce(DataFrame.union, found).distinct() if len(found) > 1 else found[0]
    ids, seen = Scratch(spark, "grams").write(ids, n=F.count(F.lit(1)))
    if trace is not None:
        trace.append(seen["n"])
    if seen["n"] <= MAX_PUSHED:
        wanted = rows.filter(F.col(key).isin([r["id"] for r in ids.collect()]))
    else:
        wanted = rows.join(ids.withColumnRenamed("id", key), key, "left_semi")
    return wanted.filter(predicate)
