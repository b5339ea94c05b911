"""A stored index of 64-bit fingerprints for "find pictures like this".

*Bands.*  A fingerprint is cut into ``BANDS`` bands of 16 bits.  Two fingerprints at distance ``<= r`` are within ``r // BANDS`` of each other in at
least one band, so a query looks up, band by band, every value that near to its own (1, 17, 137, 697 or 2517 of them).
*Storage.*  ``words`` holds each fingerprint of a batch once per band, in one folder per *slot* (band and the upper half of its value), sorted by
value; ``members`` holds (word, id), sorted by word.  So a group of copies is one word, a query opens the folders of its slots only,
and inside them the row groups of its values.
*Growth.*  New fingerprints are appended as further files; nothing stored is read, keyed or moved.  A word that comes with several batches is found
several times and reported once.

A pair that meets in several bands is kept in the first band that allows it, which the two words decide alone.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pictorium.functions.hashing import hamming
from pictorium.plans.scratch import Scratch

BANDS = 4
WIDTH = 64 // BANDS
#: Upper bits of a band's value that name its slot: 4 x 64 folders.
SLOT_BITS = 6
#: Bits a band may differ in at most, so radius 19 at most.
MOST_FLIPS = 4
#: Looked-up values that are broadcast to the index; more meet it in a shuffled join.
MAX_PROBES = 2_000_000
#: Values and words that are pushed to the scan one by one.
MAX_PUSHED = 1_000
ROW_GROUP_BYTES = 8 << 20


def _band(word: Column, band: int) -> Column:
    return F.shiftrightunsigned(word, band * WIDTH).bitwiseAND((1 << WIDTH) - 1).cast("int")


def _slot(band: Column | int, key: Column) -> Column:
    band = F.lit(band) if isinstance(band, int) else band
    return (band * (1 << SLOT_BITS) + F.shiftright(key, WIDTH - SLOT_BITS)).cast("int")


def append_fingerprints(prints: DataFrame, path: str) -> None:
    """Adds ``prints(id, word)``.  Rows are dealt by ranges, so a slot that holds a third of them is several tasks' work and several files."""
    rows, _ = Scratch(prints.sparkSession, "prints").write(prints.select("id", "word").filter(F.col("word").isNotNull()))
    bands = F.array(*[F.struct(F.lit(b).alias("band"), _band(F.col("word"), b).alias("key")) for b in range(BANDS)])
    keyed = rows.select("word").distinct().select("word", F.explode(bands).alias("b")).select(F.col("b.band").alias("band"), F.col("b.key").alias("key"), "word")
    keyed = keyed.withColumn("slot", _slot(F.col("band"), F.col("key"))).drop("band")
    dealt = keyed.repartitionByRange("slot", "key", "word").sortWithinPartitions("slot", "key", "word")
    dealt.write.mode("append").option("parquet.block.size", str(ROW_GROUP_BYTES)).partitionBy("slot").parquet(f"{path}/words")
    members = rows.repartitionByRange("word", "id").sortWithinPartitions("word", "id")
    members.write.mode("append").option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(f"{path}/members")


def _flips(most: int) -> list[int]:
    """Every way to change up to ``most`` bits of a band's value."""
    return [sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(WIDTH), n)]


def probes(queries: DataFrame, radius: int) -> DataFrame:
    """(query, slot, key): the values every query word looks up."""
    flips = F.array(*[F.lit(f) for f in _flips(radius // BANDS)])

    def of_band(band: int) -> Column:
        return F.transform(flips, lambda f: F.struct(F.lit(band).alias("band"), _band(F.col("query"), band).bitwiseXOR(f).alias("key")))

    near = [of_band(b) for b in range(BANDS)]
    rows = queries.select("query", F.explode(F.concat(*near)).alias("p"))
    return rows.select("query", _slot(F.col("p.band"), F.col("p.key")).alias("slot"), F.col("p.key").alias("key"))


def _first_band(radius: int) -> Column:
    """Whether the slot's band is the first in which the two words are near enough to meet."""
    diff = F.col("query").bitwiseXOR(F.col("word"))
    band = F.shiftright(F.col("slot"), SLOT_BITS)
    met = F.lit(True)
    for b in range(BANDS):
        near = F.bit_count(_band(diff, b)) <= radius // BANDS
        met = met & ((band <= b) | ~near)
    return met


def index_candidates(spark: SparkSession, path: str, queries: DataFrame, radius: int, max_probes: int = MAX_PROBES) -> DataFrame:
    """(query, word, distance) of stored words within the radius."""
    if radius // BANDS > MOST_FLIPS:
        raise ValueError(f"the index answers radii up to {MOST_FLIPS * BANDS + BANDS - 1}")
    scratch = Scratch(spark, "prints")
    asked, seen = scratch.write(probes(queries, radius), n=F.count(F.lit(1)))
    slots = [r["slot"] for r in asked.select("slot").distinct().collect()]  # at most BANDS * 2^SLOT_BITS
    stored = spark.read.parquet(f"{path}/words").filter(F.col("slot").isin(slots))
    if seen["n"] <= MAX_PUSHED:
        stored = stored.filter(F.col("key").isin([r["key"] for r in asked.select("key").distinct().collect()]))
    side = F.broadcast(asked) if seen["n"] <= max_probes else asked
    met = stored.join(side, ["slot", "key"])
    distance = hamming(F.col("query"), F.col("word"))
    return met.filter((distance <= radius) & _first_band(radius)).select("query", "word", distance.cast("int").alias("distance"))


def search_fingerprints(spark: SparkSession, path: str, queries: DataFrame, radius: int, max_probes: int = MAX_PROBES) -> DataFrame:
    """``(query_word, id, distance)``: stored pictures within ``radius`` of the fingerprints in ``queries(word)``."""
    words = queries.select(F.col("word").alias("query")).filter(F.col("query").isNotNull()).distinct()
    scratch = Scratch(spark, "prints")
    near, seen = scratch.write(index_candidates(spark, path, words, radius, max_probes).distinct(), n=F.count(F.lit(1)))
    members = spark.read.parquet(f"{path}/members")
    if seen["n"] <= MAX_PUSHED:
        members = members.filter(F.col("word").isin([r["word"] for r in near.select("word").distinct().collect()]))
    return members.join(near, "word").select(F.col("query").alias("query_word"), "id", "distance")
