"""Model answers, consistency, grading, result application."""

from __future__ import annotations

from pyspark.sql import functions as F

from pictorium.functions import fixed_values as V
from pictorium.functions import rules
from pictorium.operators import grading as G
from pictorium.sources import adapters as A

from .catalog import shown
from .registry import check, grade_sql, stamp, strings, view, with_views

def _list(words):
    return f"[{strings(words)}]" if words else "CAST([] AS VARCHAR[])"


def _text(template, **expressions):
    """SQL of a message: the template with SQL expressions in its places."""
    return "'" + template.format(**{k: f"' || {e} || '" for k, e in expressions.items()}) + "'"


def _case(table, column="canon"):
    return "CASE " + column + " " + " ".join(f"WHEN '{c}' THEN {_list(w)}" for c, w in table.items()) + " ELSE CAST([] AS VARCHAR[]) END"


_CASES = ", ".join(
    f"{{'category': '{c}', 'tags': {_list(t)}, 'description': '{d}'}}" for c, t, d in A.JUDGED
)
_CANON = " ".join(f"WHEN category IN ({strings(a)}) THEN '{n}'" for n, (a, _) in V.CATEGORIES.items() if a)
_SHOW = " ".join(f"WHEN '{n}' THEN '{d}'" for n, (_, d) in V.CATEGORIES.items())
view("judged", f"""
    SELECT * REPLACE (concat_ws(' ', description, text) AS description), CASE {_CANON} ELSE 'other' END AS canon FROM (
      SELECT doc_id AS id, text, ((doc_id * 37) % 100) / CAST(100 AS DOUBLE) AS confidence, unnest(
        list_extract([{_CASES}], CAST(n_chars % {len(A.JUDGED)} AS INTEGER) + 1)) FROM documents)""")
view("odd_tags", f"""
    SELECT *, CASE canon {_SHOW} END AS display, list_filter(tags, lambda t: NOT list_contains([{strings(V.GENERIC_TAGS)}], t)
        AND len(list_filter({_case(V.EXPECTED_TAG_WORDS)}, lambda w: contains(t, w))) = 0) AS odd,
      {_case(V.OPPOSITE_WORDS)} AS opposite,
      len(list_filter({_case(V.DESCRIPTION_WORDS)}, lambda w: contains(lower(description), w))) > 0 AS own
    FROM judged""", "judged")
_FAMILY = "CASE " + " ".join(f"WHEN contains(t, '{m}') THEN {_list(f)}" for m, f in V.TAG_FAMILIES) + " ELSE ['x'] END"
_KNOWN = " OR ".join(f"contains(t, '{m}')" for m, _ in V.TAG_FAMILIES)
view("conflicts", f"""
    SELECT *,
      CASE WHEN len(odd) > 0 THEN [{_text(V.CONFLICT_TAGS_TEXT, category='display', tags="array_to_string(odd, ', ')")}] ELSE CAST([] AS VARCHAR[]) END AS by_tags,
      CASE WHEN NOT own AND len(list_filter(opposite, lambda w: contains(lower(description), w))) > 0
        THEN [{_text(V.CONFLICT_DESCRIPTION_TEXT, category='display', words="array_to_string(opposite, ' / ')")}] ELSE CAST([] AS VARCHAR[]) END AS by_text,
      list_transform(list_filter(tags, lambda t: ({_KNOWN}) AND len(list_filter({_FAMILY}, lambda w: contains(lower(description), w))) = 0),
        lambda t: {_text(V.CONFLICT_SUPPORT_TEXT, tag='t')}) AS by_support
    FROM odd_tags""", "odd_tags")
view("graded", f"""
    SELECT id, confidence, canon, list_concat(list_concat(by_tags, by_text), by_support) AS conflicts,
      CASE WHEN len(by_tags) + len(by_text) + len(by_support) > 0 THEN 'rejected' ELSE {grade_sql('confidence')} END AS tag_status
    FROM conflicts""", "conflicts")


@check("g1_parse_ai_response", """
    SELECT doc_id AS id, CASE WHEN doc_id % 11 <> 0 THEN lang || '|' || source END AS tags, CASE WHEN doc_id % 11 <> 0 THEN md5(text) END AS digest,
      CASE WHEN doc_id % 11 <> 0 THEN lang END AS category,
      CASE WHEN doc_id % 11 <> 0 THEN CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN CAST(0.5 AS DOUBLE) ELSE (doc_id * 37 % 100) / CAST(100 AS DOUBLE) END END AS confidence,
      CASE WHEN doc_id % 11 = 0 THEN 'not valid JSON' END AS error FROM documents""")
def parse_ai_response(spark, d):
    out = G.parse_ai_response(A.ai_raw(spark, d))
    return out.select("id", F.array_join("tags", "|").alias("tags"), F.md5(F.col("description").cast("binary")).alias("digest"), "category", "confidence", "error")


@check("g2_normalize_category", with_views("judged", f"SELECT id, category, canon, CASE canon {_SHOW} END AS display FROM judged"))
def normalize_category(spark, d):
    canon = rules.normalize_category(F.col("category"))
    return A.judged(spark, d).select("id", "category", canon.alias("canon")).withColumn("display", rules.category_display(F.col("canon")))


def _conflict_query(name, expr, column):
    def run(spark, d):
        rows = A.judged(spark, d).withColumn("canon", rules.normalize_category(F.col("category")))
        return rows.select("id", F.array_join(expr(), "; ").alias("conflicts"))

    check(name, with_views("conflicts", f"SELECT id, array_to_string({column}, '; ') AS conflicts FROM conflicts"))(run)


_c, _t, _d = F.col, "tags", "description"
_conflict_query("g3_category_vs_tags", lambda: rules.check_category_vs_tags(F.col("canon"), F.col(_t)), "by_tags")
_conflict_query("g4_category_vs_description", lambda: rules.check_category_vs_description(F.col("canon"), F.col(_d)), "by_text")
_conflict_query("g5_tags_vs_description", lambda: rules.check_tags_vs_description(F.col(_t), F.col(_d)), "by_support")


@check("g6_check_all", with_views("graded", "SELECT id, array_to_string(conflicts, '; ') AS conflicts, len(conflicts) > 0 AS has_conflicts FROM graded"))
def check_all(spark, d):
    return G.check_consistency(A.judged(spark, d)).select("id", F.array_join("conflicts", "; ").alias("conflicts"), "has_conflicts")


@check("g7_grade", with_views("graded", "SELECT id, confidence, tag_status FROM graded"))
def grade(spark, d):
    return G.grade_results(A.judged(spark, d)).select("id", "confidence", "tag_status")


@check("g8_derive_is_correct", with_views("graded", """
    SELECT id, tag_status, CASE tag_status WHEN 'verified' THEN TRUE WHEN 'rejected' THEN FALSE ELSE confidence >= 0.7 END AS is_correct FROM graded"""))
def derive_is_correct(spark, d):
    return G.grade_results(A.judged(spark, d)).select("id", "tag_status", "is_correct")


@check("g9_apply_results", with_views("assets, graded, judged", f"""
    SELECT a.id, CASE WHEN l.doc_id IS NULL THEN a.ai_status ELSE 'completed' END AS ai_status,
      CASE WHEN l.doc_id IS NULL THEN a.ai_category ELSE j.category END AS ai_category,
      CASE WHEN l.doc_id IS NULL THEN a.ai_tag_status ELSE g.tag_status END AS ai_tag_status,
      array_to_string(CASE WHEN l.doc_id IS NULL THEN a.ai_tags ELSE j.tags END, '|') AS tags,
      CASE WHEN l.doc_id IS NULL THEN a.ai_error_message ELSE '' END AS ai_error_message,
      CASE WHEN l.doc_id IS NULL THEN {stamp("a.ai_processed_at")} ELSE '2024-06-01 00:00:00' END AS ai_processed_at
    FROM assets a JOIN graded g ON g.id = a.id JOIN judged j ON j.id = a.id LEFT JOIN labels l ON l.doc_id = a.id"""))
def apply_results(spark, d):
    labelled = A.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    results = G.grade_results(A.judged(spark, d).join(labelled, "id", "left_semi"))
    out = G.apply_results(A.assets(spark, d), results, F.lit("2024-06-01").cast("timestamp_ntz"))
    return out.select(
        "id", "ai_status", "ai_category", "ai_tag_status", F.array_join("ai_tags", "|").alias("tags"), "ai_error_message", shown("ai_processed_at")
    )


@check("g10_apply_failures", with_views("assets", """
    SELECT a.id, CASE WHEN l.doc_id IS NULL THEN ai_status WHEN ai_retry_count + 1 < 3 THEN 'pending' ELSE 'failed' END AS ai_status,
      CASE WHEN l.doc_id IS NULL THEN ai_retry_count ELSE ai_retry_count + 1 END AS ai_retry_count,
      CASE WHEN l.doc_id IS NULL THEN ai_error_message ELSE 'quality ' || l.quality END AS ai_error_message,
      CASE WHEN l.doc_id IS NOT NULL AND ai_retry_count + 1 < 3 THEN CAST(pow(2, ai_retry_count + 1) * 1000 AS BIGINT) END AS backoff_ms
    FROM assets a LEFT JOIN labels l ON l.doc_id = a.id"""))
def apply_failures(spark, d):
    failures = A.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("error"))
    return G.apply_failures(A.assets(spark, d), failures).select("id", "ai_status", "ai_retry_count", "ai_error_message", "backoff_ms")


_LABELS = [f"kind{i}" for i in range(40)]


@check("g11_top_predictions", f"""
    WITH s AS (SELECT vec_id, unnest(embedding) AS score, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
    r AS (SELECT vec_id, i, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i) AS rn FROM s)
    SELECT vec_id, rn - 1 AS position, CASE WHEN i < 40 THEN 'kind' || i ELSE 'class_' || i END AS label, round(score, 6) AS confidence,
      first_value(CASE WHEN i < 40 THEN 'kind' || i ELSE 'class_' || i END) OVER (PARTITION BY vec_id ORDER BY rn) AS top_label
    FROM r WHERE rn <= 5""")
def top_predictions(spark, d):
    out = G.top_predictions(A.table(spark, d, "embeddings"), "embedding", _LABELS, 5)
    rows = out.select("vec_id", F.col("label").alias("top_label"), F.posexplode("predictions").alias("position", "p"))
    return rows.select("vec_id", F.col("position").cast("long").alias("position"), "p.label", F.round("p.confidence", 6).alias("confidence"), "top_label")


@check("g12_decode_detections", """
    WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, 640 + 10 * label AS w, 480 + 5 * label AS h FROM embeddings),
    k AS (SELECT *, unnest(range(0, 4)) AS detection FROM s)
    SELECT vec_id, detection, round(v[detection * 15 + 1] * w / 640.0, 6) AS x, round(v[detection * 15 + 2] * h / 640.0, 6) AS y,
      round((v[detection * 15 + 3] - v[detection * 15 + 1]) * w / 640.0, 6) AS box_width,
      round((v[detection * 15 + 4] - v[detection * 15 + 2]) * h / 640.0, 6) AS box_height,
      round(v[detection * 15 + 13] * w / 640.0, 6) AS last_x, round(v[detection * 15 + 14] * h / 640.0, 6) AS last_y,
      round(v[detection * 15 + 15], 6) AS confidence
    FROM k WHERE v[detection * 15 + 15] >= 0.05""")
def decode_detections(spark, d):
    rows = A.table(spark, d, "embeddings").select("vec_id", "embedding", (640 + 10 * F.col("label")).alias("w"), (480 + 5 * F.col("label")).alias("h"))
    out = G.decode_detections(rows, "embedding", "w", "h", 0.05, ["vec_id"])
    last = F.element_at("landmarks", -1)

    def r(c):
        return F.round(c, 6)

    return out.select(
        "vec_id", "detection", r("x").alias("x"), r("y").alias("y"), r("box_width").alias("box_width"), r("box_height").alias("box_height"),
        r(last["x"]).alias("last_x"), r(last["y"]).alias("last_y"), r("confidence").alias("confidence"),
    )


@check("g13_backfill_tag_status", with_views("assets", """
    SELECT id, CASE WHEN ai_tag_status = 'verified' THEN ai_tag_status WHEN ai_status IN ('pending', 'failed') THEN 'rejected' ELSE 'provisional' END AS ai_tag_status
    FROM assets"""))
def backfill_tag_status(spark, d):
    unset = A.assets(spark, d).withColumn("ai_tag_status", F.when(F.col("ai_tag_status") == "verified", F.col("ai_tag_status")))
    return G.backfill_tag_status(unset).select("id", "ai_tag_status")
