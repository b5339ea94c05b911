"""Catalog, facets, work lists, corrections, patterns, settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pictorium.functions import text
from pictorium.operators import catalog as C
from pictorium.operators import common, curation, substring_index
from pictorium.plans.scratch import new_path
from pictorium.sources import adapters as A
from pictorium.sources import tables

from .registry import check, stamp, with_views


def shown(column="created_at"):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


SLIM = ["id", "file_path", "ai_status", "ai_category"]
_ORDER = "ORDER BY created_at DESC, id DESC"


@check("a2_read_catalog", with_views("assets", f"""
    SELECT id, file_path, file_name, file_size, file_hash, width, height, ai_status, ai_category,
      array_to_string(ai_tags, '|') AS tags, ai_confidence, {stamp("created_at")} AS created_at FROM assets"""))
def read_catalog(spark, d):
    root = new_path(spark, "catalog")
    A.assets(spark, d).write.parquet(f"{root}/images")
    return tables.read_catalog(spark, root, "images").select(
        "id", "file_path", "file_name", "file_size", "file_hash", "width", "height", "ai_status", "ai_category",
        F.array_join("ai_tags", "|").alias("tags"), "ai_confidence", shown(),
    )


@check("a4_get_by_id", with_views("assets", "SELECT id, file_path, ai_status FROM assets WHERE id = 42"))
def get_by_id(spark, d):
    return C.get_by_id(A.assets(spark, d), 42).select("id", "file_path", "ai_status")


@check("d1_list_assets", with_views("assets", f"""
    SELECT id, file_path, ai_status, ai_category, {stamp("created_at")} AS created_at,
      coalesce(generation_source, 'manual_import') AS generation_source
    FROM assets WHERE ai_status = 'completed' AND ai_category = 'en' AND list_contains(ai_tags, 'clean')
      AND created_at >= TIMESTAMP '2024-01-01' AND created_at <= TIMESTAMP '2024-12-31'
    {_ORDER} LIMIT 20 OFFSET 20"""))
def list_assets(spark, d):
    out = C.list_assets(
        A.assets(spark, d), 2, 20, status="completed", category="en", tags=["clean"], start="2024-01-01", end="2024-12-31"
    )
    return out.select(*SLIM, shown(), "generation_source")


@check("d2_count_assets", with_views("assets", "SELECT count(*) AS total FROM assets WHERE ai_status = 'failed' AND ai_category = 'en'"))
def count_assets(spark, d):
    return C.count_assets(A.assets(spark, d), status="failed", category="en")


@check("d3_filter_by_tags", with_views("assets", """
    SELECT id, 'exact' AS how FROM assets WHERE list_contains(ai_tags, 'en') AND list_contains(ai_tags, 'clean')
    UNION ALL
    SELECT id, 'substring' AS how FROM assets WHERE contains(array_to_string(ai_tags, '","'), 'src1') AND list_contains(ai_tags, 'fr')"""))
def filter_by_tags(spark, d):
    assets = A.assets(spark, d)
    exact = C.filter_by_tags(assets, ["en", "clean"]).select("id", F.lit("exact").alias("how"))
    loose = C.filter_by_tags(assets, ["SRC1", '"fr"'], "substring").select("id", F.lit("substring").alias("how"))
    return exact.unionByName(loose)


@check("d4_like_escaped", """
    SELECT doc_id, contains(lower(text), lower('%%%')) AS percent, contains(lower(text), lower('Token = "')) AS quoted
    FROM documents""")
def like_escaped(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.select(
        "doc_id",
        text.contains_ci(F.col("text"), "%%%").alias("percent"),
        text.contains_ci(F.col("text"), 'Token = "').alias("quoted"),
    )


@check("d5_facet_categories", with_views("assets", "SELECT DISTINCT ai_category FROM assets WHERE ai_category IS NOT NULL"))
def facet_categories(spark, d):
    return C.facet_categories(A.assets(spark, d))


@check("d5_facet_tags", with_views("assets", "SELECT DISTINCT unnest(ai_tags) AS tag FROM assets"))
def facet_tags(spark, d):
    return C.facet_tags(A.assets(spark, d))


@check("d6_recent_results", with_views("assets", f"""
    SELECT id, ai_status, {stamp("ai_processed_at")} AS ai_processed_at FROM assets
    WHERE ai_status IN ('completed', 'failed') AND ai_processed_at IS NOT NULL
    ORDER BY assets.ai_processed_at DESC, id DESC LIMIT 50"""))
def recent_results(spark, d):
    return C.recent_results(A.assets(spark, d)).select("id", "ai_status", shown("ai_processed_at"))


@check("d7_pending_work", with_views("assets", "SELECT id, file_path, ai_retry_count FROM assets WHERE ai_status = 'pending'"))
def pending_work(spark, d):
    return C.pending_work(A.assets(spark, d)).drop("created_at")


@check("d7_retryable_work", with_views("assets", """
    SELECT id, file_path, ai_retry_count FROM assets WHERE ai_status = 'failed' AND ai_retry_count < 3"""))
def retryable_work(spark, d):
    return C.retryable_work(A.assets(spark, d))


@check("d8_eligible_batch", with_views("assets", """
    SELECT id, ai_status FROM assets WHERE ai_status IN ('pending', 'failed') AND id IN (SELECT doc_id FROM labels)"""))
def eligible_batch(spark, d):
    ids = A.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return C.eligible_batch(A.assets(spark, d), ids).select("id", "ai_status")


@check("d9_list_with_filter", with_views("assets", f"""
    (SELECT id, file_name, {stamp("created_at")} AS created_at, 'category' AS clause FROM assets WHERE ai_category = 'fr'
     ORDER BY assets.created_at DESC, id DESC LIMIT 20)
    UNION ALL
    (SELECT id, file_name, {stamp("created_at")} AS created_at, 'date' AS clause FROM assets
     WHERE created_at >= TIMESTAMP '2024-01-01 02:00:00'
     ORDER BY assets.created_at DESC, id DESC LIMIT 10 OFFSET 10)
    UNION ALL
    SELECT count(*), NULL, NULL, 'total' FROM assets WHERE ai_category = 'fr'"""))
def list_with_filter(spark, d):
    assets = A.assets(spark, d)
    one = C.list_with_filter(assets, "category:fr").select("id", "file_name", shown(), F.lit("category").alias("clause"))
    two = C.list_with_filter(assets, "date:2024-01-01 02:00:00", 2, 10).select("id", "file_name", shown(), F.lit("date").alias("clause"))
    total = C.count_with_filter(assets, "category:fr").select(
        F.col("total").alias("id"), F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("string").alias("created_at"),
        F.lit("total").alias("clause"),
    )
    return one.unionByName(two).unionByName(total)


KEYWORDS = with_views("assets", f"""
    SELECT id, file_name FROM assets
    WHERE (contains(lower(array_to_string(ai_tags, ',')), 'src12') OR contains(lower(ai_description), 'src12') OR contains(file_name, 'src12')
       OR contains(lower(array_to_string(ai_tags, ',')), 'thre') OR contains(lower(ai_description), 'thre') OR contains(file_name, 'thre'))
      AND ai_category = 'en'
    {_ORDER} LIMIT 20""")


@check("d10_keyword_search", KEYWORDS)
def keyword_search(spark, d):
    return C.keyword_search(A.assets(spark, d), "src12 Thre", "en").select("id", "file_name")


@check("d10_indexed_keyword_search", KEYWORDS)
def indexed_keyword_search(spark, d):
    """The same by a stored substring index, written in two parts."""
    assets, path = A.assets(spark, d), new_path(spark, "substrings")
    texts = C.keyword_texts(assets)
    for part in (texts.filter("id % 2 = 0"), texts.filter("id % 2 <> 0")):
        substring_index.append_texts(part, path)
    return C.indexed_keyword_search(assets, path, "src12 Thre", "en").select("id", "file_name")


@check("d11_by_source", with_views("assets, postings", """
    SELECT 'count' AS what, count(*) AS n FROM assets WHERE source = 'src2'
    UNION ALL SELECT 'kept', count(*) FROM assets WHERE source <> 'src2'
    UNION ALL SELECT 'kept_postings', count(*) FROM postings WHERE image_id NOT IN (SELECT id FROM assets WHERE source = 'src2')"""))
def by_source(spark, d):
    from pictorium.operators.search import build_index

    assets = A.assets(spark, d)
    kept, postings = C.delete_by_source(assets, build_index(assets), "src2")

    def counted(what, df):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")

    first = C.count_by_source(assets, "src2").select(F.lit("count").alias("what"), "n")
    return first.unionByName(counted("kept", kept)).unionByName(counted("kept_postings", postings))


@check("d12_json_string_array", """
    SELECT event_id, 1 AS raw_tags, CASE WHEN event_type = 'error' THEN 0 ELSE 2 END AS parsed_tags,
      CASE WHEN event_type = 'error' THEN '' ELSE event_type || '|x' END AS tags FROM events""")
def json_string_array(spark, d):
    events = A.table(spark, d, "events")
    listed = F.concat(F.lit('["'), "event_type", F.lit('","x"]'))
    raw = F.when(F.col("event_type") == "error", F.col("props")).otherwise(listed)
    tags = text.json_strings(raw)
    return events.select(
        "event_id",
        F.size(text.json_strings_or_raw(F.col("event_type"))).alias("raw_tags"),
        F.size(tags).alias("parsed_tags"),
        F.array_join(tags, "|").alias("tags"),
    )


@check("d13_defaults", with_views("assets", """
    SELECT id, coalesce(ai_category, '') AS ai_category, coalesce(ai_error_message, '') AS ai_error_message,
      coalesce(generation_source, 'manual_import') AS generation_source FROM assets"""))
def with_defaults(spark, d):
    return C.with_defaults(A.assets(spark, d)).select("id", "ai_category", "ai_error_message", "generation_source")


def _tag_sql(expr):
    return with_views("assets", f"SELECT id, array_to_string({expr}, '|') AS tags FROM assets")


def _tag_query(operation, given):
    def run(spark, d):
        assets = A.assets(spark, d)
        tags = F.array(*[F.lit(t) for t in given])
        return assets.select("id", F.array_join(curation.OPERATIONS[operation](F.col("ai_tags"), tags), "|").alias("tags"))

    return run


check("i1_tags_add", _tag_sql("""CASE WHEN list_contains(ai_tags, 'clean') THEN list_concat(ai_tags, ['new'])
    ELSE list_concat(ai_tags, ['clean', 'new']) END"""))(_tag_query("add", ["clean", "new"]))
check("i2_tags_remove", _tag_sql("list_filter(ai_tags, lambda t: t NOT IN ('clean', 'en'))"))(_tag_query("remove", ["clean", "en"]))
check("i3_tags_replace", _tag_sql("['a', 'b']"))(_tag_query("replace", ["a", "b"]))


@check("i4_batch_tag_correction", with_views("assets", """
    SELECT id AS image_id, array_to_string(ai_tags, '|') AS old_tags, array_to_string(list_concat(ai_tags, ['seen']), '|') AS new_tags
    FROM assets WHERE id IN (SELECT conv_id * 20 FROM conversations)
    UNION ALL
    SELECT DISTINCT conv_id * 20, NULL, 'unknown' FROM conversations WHERE conv_id * 20 NOT IN (SELECT id FROM assets)
    UNION ALL
    SELECT count(*) FILTER (WHERE known), CAST(count(*) FILTER (WHERE NOT known) AS VARCHAR), 'counts' FROM
      (SELECT DISTINCT conv_id * 20 IN (SELECT id FROM assets) AS known, conv_id FROM conversations)"""))
def batch_tag_correction(spark, d):
    assets = A.assets(spark, d)
    ids = A.table(spark, d, "conversations").select((F.col("conv_id") * 20).alias("id"))
    good, bad = curation.batch_tag_correction(assets, ids, ["seen"], "add")
    none = F.lit(None).cast("string")
    rows = good.select("image_id", F.array_join("old_tags", "|").alias("old_tags"), F.array_join("new_tags", "|").alias("new_tags"))
    failed = bad.select(F.col("id").alias("image_id"), none.alias("old_tags"), F.lit("unknown").alias("new_tags"))
    counts = curation.correction_counts(good, bad).select(
        F.col("success_count").alias("image_id"), F.col("failed_count").cast("string").alias("old_tags"), F.lit("counts").alias("new_tags")
    )
    return rows.unionByName(failed).unionByName(counts)


@check("i5_record_correction", with_views("corrections, assets", f"""
    SELECT a.id, array_to_string(coalesce(c.new_tags, a.ai_tags), '|') AS tags,
      CASE WHEN c.id IS NOT NULL THEN 'tag_correction_' || a.id END AS pattern_name,
      CASE WHEN c.id IS NOT NULL THEN CAST(1 AS BIGINT) END AS occurrence_count
    FROM assets a LEFT JOIN corrections c ON c.id = a.id"""))
def record_correction(spark, d):
    assets = A.assets(spark, d)
    none = curation.count_patterns(A.error_events(spark, d).filter(F.lit(False)))
    good, patterns = curation.record_corrections(A.corrections(spark, d), none, F.col("corrected_at"))
    fixed = curation.apply_corrections(assets, good)
    named = fixed.select("id", F.array_join("ai_tags", "|").alias("tags"), F.concat(F.lit("tag_correction_"), F.col("id").cast("string")).alias("_name"))
    found = patterns.select(F.col("pattern_name").alias("_name"), "pattern_name", "occurrence_count")
    return named.join(found, "_name", "left").drop("_name")


@check("i6_correction_history", with_views("corrections", f"""
    SELECT image_id, array_to_string(new_tags, '|') AS new_tags, {stamp("corrected_at")} AS corrected_at, 'all' AS part
    FROM (SELECT * FROM corrections ORDER BY corrected_at DESC, id DESC LIMIT 100 OFFSET 10)
    UNION ALL
    SELECT image_id, array_to_string(new_tags, '|'), {stamp("corrected_at")}, 'one' FROM corrections WHERE image_id = 21"""))
def correction_history(spark, d):
    rows = A.corrections(spark, d)

    def out(df, part):
        return df.select("image_id", F.array_join("new_tags", "|").alias("new_tags"), shown("corrected_at"), F.lit(part).alias("part"))

    return out(curation.all_corrections(rows, 100, 10), "all").unionByName(out(curation.correction_history(rows, 21), "one"))


_PATTERNS = "SELECT pattern_name, count(*) AS occurrence_count, min(ts) AS first_seen, max(ts) AS last_seen FROM error_events GROUP BY 1"


@check("i7_top_error_patterns", with_views("error_events", f"""
    WITH p AS ({_PATTERNS})
    (SELECT pattern_name, occurrence_count, 'top' AS part FROM p WHERE occurrence_count >= 5 ORDER BY occurrence_count DESC, pattern_name LIMIT 50)
    UNION ALL
    (SELECT pattern_name, occurrence_count, 'high' AS part FROM p WHERE occurrence_count >= 10 ORDER BY occurrence_count DESC, pattern_name LIMIT 20)"""))
def top_error_patterns(spark, d):
    patterns = curation.count_patterns(A.error_events(spark, d)).select("pattern_name", "occurrence_count")
    top = curation.top_patterns(patterns, 50, 5).withColumn("part", F.lit("top"))
    return top.unionByName(curation.high_frequency_patterns(patterns, 10).withColumn("part", F.lit("high")))


@check("i8_pattern_lookup", with_views("error_events", f"""
    WITH p AS ({_PATTERNS})
    SELECT 'present' AS what, CAST(count(*) > 0 AS BIGINT) AS n FROM p WHERE pattern_name = 'u8'
    UNION ALL SELECT 'absent', CAST(count(*) > 0 AS BIGINT) FROM p WHERE pattern_name = 'nobody'
    UNION ALL SELECT 'left', count(*) FROM p WHERE pattern_name <> 'u8'"""))
def pattern_lookup(spark, d):
    patterns = curation.count_patterns(A.error_events(spark, d))

    def flag(what, name):
        return curation.pattern_exists(patterns, name).select(F.lit(what).alias("what"), F.col("present").cast("long").alias("n"))

    left = curation.delete_pattern(patterns, "u8").agg(F.count(F.lit(1)).alias("n")).select(F.lit("left").alias("what"), "n")
    return flag("present", "u8").unionByName(flag("absent", "nobody")).unionByName(left)


@check("i9_record_patterns", with_views("error_events", f"""
    SELECT pattern_name, count(*) AS occurrence_count, {stamp("min(ts)")} AS first_seen, {stamp("max(ts)")} AS last_seen
    FROM error_events GROUP BY 1"""))
def record_patterns(spark, d):
    events = A.error_events(spark, d)
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    base = curation.count_patterns(events.filter(F.col("ts") < cut))
    merged = curation.record_patterns(base, events.filter(F.col("ts") >= cut))
    return merged.select("pattern_name", "occurrence_count", shown("first_seen"), shown("last_seen"))


@check("i10_upsert_latest", """
    SELECT coalesce(c.key, b.key) AS key, coalesce(c.value, b.value) AS value, b.value AS ignored
    FROM (SELECT 'u' || c_custkey AS key, c_mktsegment AS value FROM customer) b
    FULL JOIN (SELECT 'u' || user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY 1) c ON b.key = c.key
    WHERE b.key IS NOT NULL OR c.key IS NOT NULL""")
def upsert_latest(spark, d):
    base = A.table(spark, d, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("value"), F.lit(-1).cast("long").alias("version")
    )
    changes = A.table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("version")
    )
    replaced = common.upsert_latest(base, changes, ["key"], "version").select("key", "value")
    ignored = common.upsert_latest(base, changes, ["key"], "version", ignore=True).select("key", F.col("value").alias("ignored"), "version")
    kept = ignored.select("key", F.when(F.col("version") == -1, F.col("ignored")).alias("ignored"))
    return replaced.join(kept, "key")


@check("i11_update_where", with_views("assets", """
    SELECT a.id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.toxic = 1 THEN NULL ELSE 'checked' END ELSE a.ai_category END AS ai_category
    FROM assets a LEFT JOIN labels l ON l.doc_id = a.id"""))
def update_where(spark, d):
    changes = A.table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("toxic") == 0, F.lit("checked")).alias("ai_category")
    )
    return common.update_where(A.assets(spark, d), changes, "id", ["ai_category"]).select("id", "ai_category")


@check("i12_list_settings", "SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation")
def list_settings(spark, d):
    return curation.list_settings(A.settings(spark, d))
