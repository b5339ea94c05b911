"""URL filters: a temporal join of captures with dated lists.

DataFrame operations only.  A list is a log of changes (list, pattern, changed_at, add or
remove).  Consecutive changes of one entry become validity intervals
``[valid_from, valid_to)``.  A capture is judged by the entries that were active
when it was fetched: its host, the parent domains, and host with first path
segment are its keys.

Interval and capture meet by equality on (pattern, time slot) plus the exact range condition.  An
interval is posted to those of the slots it covers (32 days each) in which anything was fetched, so an
entry with a long history, or a host with a third of all captures, is spread over the slots
and never compared as all changes with all captures, and one fetch dated far ahead adds one slot. The runs of
such slots go to the driver: years 1 to 9999 have 114,145 slots in all.  Intervals are a written table and captures a
plain scan, so AQE can split what is still skewed.

The most specific active pattern decides; at equal specificity ``allow`` beats
``block``; then the larger list name.  Changes at one instant: the entry is active afterwards if any of
them is an addition.  A null URL or fetch time has no active entries.  Rows repeat as they are;
empty lists give verdict ``none``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pictorium.plans.scratch import materialize

SLOT_SECONDS = 32 * 86400
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
FIRST_SEGMENT = r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+(/[^/?#]+)"


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, HOST, 1), F.lit("")))


def match_keys(url: Column) -> Column:
    """Array of (pattern, specificity): domains by number of labels (two at
    least, or the whole host), host with path segment above all."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    first = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    domains = F.transform(first, lambda i: F.struct(F.array_join(F.slice(labels, i, n), ".").alias("pattern"), (n - i + 1).alias("specificity")))
    segment = F.nullif(F.regexp_extract(url, FIRST_SEGMENT, 1), F.lit(""))
    path = F.when(segment.isNotNull(), F.array(F.struct(F.concat(host, segment).alias("pattern"), F.lit(1000).alias("specificity"))))
    return F.when(host.isNotNull(), F.concat(domains, F.coalesce(path, F.array().cast("array<struct<pattern:string,specificity:int>>"))))


def validity_intervals(changes: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to) in seconds; open ones have null ``valid_to``."""
    seconds = F.unix_seconds(F.col("changed_at").cast("timestamp"))
    known = changes.filter(F.col("list").isNotNull() & F.col("pattern").isNotNull() & F.col("changed_at").isNotNull())
    states = known.groupBy("list", "pattern", seconds.alias("at")).agg(F.max((F.col("action") == "add").cast("int")).alias("active"))
    own = Window.partitionBy("list", "pattern").orderBy("at")
    turned = states.withColumn("before", F.lag("active", 1, 0).over(own)).filter(F.col("active") != F.col("before"))
    spans = turned.withColumn("valid_to", F.lead("at").over(own))
    return spans.filter("active = 1").select("list", "pattern", F.col("at").alias("valid_from"), "valid_to")


def fetch_runs(rows: DataFrame) -> list[tuple[int, int]]:
    """Runs (first, last) of the slots that hold a fetch time ``at``."""
    slots = sorted(r["slot"] for r in rows.select(F.floor(F.col("at") / SLOT_SECONDS).alias("slot")).filter("slot IS NOT NULL").distinct().collect())
    runs: list[tuple[int, int]] = []
    for slot in slots:
        if runs and slot == runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], slot)
        else:
            runs.append((slot, slot))
    return runs


def slots_met(first: Column, last: Column, runs: list[tuple[int, int]]) -> Column:
    """Array of the slots from ``first`` to ``last`` (null: open) that lie in a run."""
    if not runs:
        return F.array().cast("array<bigint>")
    known = F.split(F.lit(",".join(f"{a}:{b}" for a, b in runs)), ",")
    ends = F.transform(known, lambda r: F.split(r, ":").cast("array<bigint>"))
    bound = F.transform(ends, lambda r: F.struct(r[0].alias("a"), r[1].alias("b")))
    cut = F.transform(bound, lambda r: F.struct(F.greatest(r["a"], first).alias("a"), F.when(last.isNull(), r["b"]).otherwise(F.least(r["b"], last)).alias("b")))
    return F.flatten(F.transform(F.filter(cut, lambda r: r["a"] <= r["b"]), lambda r: F.sequence(r["a"], r["b"])))


def judge_captures(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, fetched_at) judged at fetch time: page_id, host, fetched_second,
    n_active, list, pattern, verdict (``allow``, ``block`` or ``none``)."""
    rows = captures.select(
        F.monotonically_increasing_id().alias("row"),
        "page_id",
        host_of(F.col("url")).alias("host"),
        F.unix_seconds(F.col("fetched_at").cast("timestamp")).alias("at"),
        match_keys(F.col("url")).alias("keys"),
    )
    runs = fetch_runs(rows)
    intervals = materialize(validity_intervals(changes), "url-intervals")
    slots = slots_met(F.floor(F.col("valid_from") / SLOT_SECONDS), F.floor(F.col("valid_to") / SLOT_SECONDS), runs)
    posted = intervals.select("list", F.col("pattern").alias("entry"), "valid_from", "valid_to", F.explode(slots).alias("entry_slot"))
    keyed = rows.select("row", "page_id", "host", "at", F.floor(F.col("at") / SLOT_SECONDS).alias("slot"), F.explode_outer("keys").alias("key"))
    keyed = keyed.select("row", "page_id", "host", "at", "slot", "key.pattern", "key.specificity")
    active = (keyed["pattern"] == posted["entry"]) & (keyed["slot"] == posted["entry_slot"]) & (keyed["at"] >= posted["valid_from"])
    active = active & (posted["valid_to"].isNull() | (keyed["at"] < posted["valid_to"]))
    met = keyed.join(posted, active, "left")
    rank = F.struct(F.col("specificity"), (F.col("list") == "allow").cast("int").alias("allows"))
    best = met.groupBy("row").agg(
        F.first("page_id").alias("page_id"),
        F.first("host").alias("host"),
        F.first("at").alias("fetched_second"),
        F.count("entry").alias("n_active"),
        F.max(F.when(F.col("entry").isNotNull(), F.struct(rank.alias("rank"), "entry", "list"))).alias("best"),
    )
    return best.select(
        "page_id",
        "host",
        "fetched_second",
        "n_active",
        F.col("best.list").alias("list"),
        F.col("best.entry").alias("pattern"),
        F.when(F.col("best").isNull(), "none").when(F.col("best.list") == "allow", "allow").otherwise("block").alias("verdict"),
    )


# --- captures and list changes that Spark derives from the page table -----------------------------------

DAY = 86400
START = 1_704_067_200  # 2024-01-01 00:00:00 UTC


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time within one year, spread by their number."""
    at = F.lit(START) + (F.col("page_id") * 7919 % 525_600) * 60
    return pages.select("page_id", "url", F.timestamp_seconds(at).alias("fetched_at"))


def changes_of(pages: DataFrame) -> DataFrame:
    """A dated log over the patterns of the pages: by a hash of its name a
    pattern is on no list, comes and goes on the block list, or is allowed for a time."""
    patterns = pages.select(F.explode(match_keys(F.col("url"))).alias("k")).select("k.pattern").distinct()
    h = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long")
    day = h % 300

    def change(name: str, after, action: str) -> Column:
        return F.struct(F.lit(name).alias("list"), (F.lit(START) + (day + after) * DAY).alias("at"), F.lit(action).alias("action"))

    block = [change("block", F.lit(0), "add"), change("block", 5 + h % 40, "remove"), change("block", 60 + h % 30, "add")]
    allow = [change("allow", F.lit(10), "add"), change("allow", 10 + h % 20, "remove")]
    empty = F.array().cast("array<struct<list:string,at:bigint,action:string>>")
    log = F.concat(F.when(h % 3 == 0, F.array(*block)).otherwise(empty), F.when(h % 5 == 0, F.array(*allow)).otherwise(empty))
    flat = patterns.select("pattern", F.explode(log).alias("c"))
    return flat.select("c.list", "pattern", F.timestamp_seconds("c.at").alias("changed_at"), "c.action")


ORACLE_SQL = rf"""
WITH captures AS (
  SELECT page_id, url, {START} + (page_id * 7919 % 525600) * 60 AS sec,
    lower(nullif(regexp_extract(url, '{HOST}', 1), '')) AS host,
    nullif(regexp_extract(url, '{FIRST_SEGMENT}', 1), '') AS segment FROM pages),
keys AS (
  SELECT page_id, host, sec, array_to_string(labels[i:len(labels)], '.') AS pattern, len(labels) - i + 1 AS specificity
  FROM (SELECT page_id, host, sec, labels, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i
        FROM (SELECT *, string_split(host, '.') AS labels FROM captures WHERE host IS NOT NULL))
  UNION ALL SELECT page_id, host, sec, host || segment, 1000 FROM captures WHERE segment IS NOT NULL AND host IS NOT NULL),
hashed AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS BIGINT) AS h FROM (SELECT DISTINCT pattern FROM keys)),
changes AS (
  SELECT 'block' AS list, pattern, {START} + (h % 300) * {DAY} AS sec, 1 AS active FROM hashed WHERE h % 3 = 0
  UNION ALL SELECT 'block', pattern, {START} + (h % 300 + 5 + h % 40) * {DAY}, 0 FROM hashed WHERE h % 3 = 0
  UNION ALL SELECT 'block', pattern, {START} + (h % 300 + 60 + h % 30) * {DAY}, 1 FROM hashed WHERE h % 3 = 0
  UNION ALL SELECT 'allow', pattern, {START} + (h % 300 + 10) * {DAY}, 1 FROM hashed WHERE h % 5 = 0
  UNION ALL SELECT 'allow', pattern, {START} + (h % 300 + 10 + h % 20) * {DAY}, 0 FROM hashed WHERE h % 5 = 0),
states AS (SELECT list, pattern, sec, max(active) AS active FROM changes GROUP BY ALL),
spans AS (SELECT *, lead(sec) OVER (PARTITION BY list, pattern ORDER BY sec) AS valid_to FROM states),
met AS (
  SELECT k.page_id, s.list, s.pattern, k.specificity, CAST(s.list = 'allow' AS INTEGER) AS allows
  FROM keys k JOIN spans s ON s.pattern = k.pattern AND s.active = 1 AND k.sec >= s.sec AND (s.valid_to IS NULL OR k.sec < s.valid_to)),
best AS (
  SELECT *, count(*) OVER (PARTITION BY page_id) AS n,
    row_number() OVER (PARTITION BY page_id ORDER BY specificity DESC, allows DESC, pattern DESC, list DESC) AS r FROM met)
SELECT c.page_id, c.host, c.sec AS fetched_second, coalesce(b.n, 0) AS n_active, b.list, b.pattern,
  CASE WHEN b.list IS NULL THEN 'none' WHEN b.list = 'allow' THEN 'allow' ELSE 'block' END AS verdict
FROM captures c LEFT JOIN best b ON b.page_id = c.page_id AND b.r = 1
"""
