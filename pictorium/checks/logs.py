"""Logs, redaction and narrative extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from pictorium.functions import entities, redact
from pictorium.functions import fixed_values as V
from pictorium.operators import logs as L
from pictorium.operators import narratives as N
from pictorium.sources import adapters as A

from .catalog import shown
from .registry import check, stamp, strings, view, with_views

_FIELDS = """seq, CASE WHEN full_line THEN p[1] ELSE '' END AS timestamp, CASE WHEN full_line THEN trim(p[2], '{}') ELSE 'UNKNOWN' END AS level,
    CASE WHEN full_line THEN p[3] ELSE '' END AS target, CASE WHEN full_line THEN array_to_string(p[4:], ' ') ELSE line END AS message"""
view("log_parts", "SELECT seq, line, string_split(line, ' ') AS p, len(string_split(line, ' ')) >= 4 AS full_line FROM log_lines", "log_lines")


@check("m1_parse_log", with_views("log_parts", f"SELECT {_FIELDS} FROM log_parts"))
def parse_log(spark, d):
    return L.parse_log(A.log_lines(spark, d))


@check("m2_page_log", with_views("log_parts", f"SELECT {_FIELDS} FROM log_parts WHERE seq > 100 AND contains(line, 'ERROR') ORDER BY seq LIMIT 200"))
def page_log(spark, d):
    return L.page_log(A.log_lines(spark, d), 200, 100, "error")


@check("m2_page_info", with_views("log_lines", """
    SELECT total AS total_lines, least(hits, 200) AS returned, total > 100 + least(hits, 200) AS has_more
    FROM (SELECT count(*) AS total, count(*) FILTER (WHERE seq > 100 AND contains(line, 'ERROR')) AS hits FROM log_lines)"""))
def page_info(spark, d):
    return L.page_info(A.log_lines(spark, d), 200, 100, "error")


@check("m3_log_stats", with_views("log_lines", "SELECT CAST(sum(strlen(line) + 1) AS BIGINT) AS size_bytes, count(*) AS line_count FROM log_lines"))
def log_stats(spark, d):
    return L.log_stats(A.log_lines(spark, d))


_NOTES = f"list_extract([{strings(A.NOTES)}], CAST(n_chars % {len(A.NOTES)} AS INTEGER) + 1) || ' ' || text"
_CJK = r"[\x{4E00}-\x{9FFF}]"
view("notes", f"SELECT doc_id AS id, doc_id AS image_id, {_NOTES} AS content FROM documents")
_AFTER = [f"regexp_extract_all(content, '{p}({_CJK})', 1)" for p in V.PERSON_PREFIXES]
view("persons", "SELECT id, list_distinct(list_concat(list_concat({}, {}), {})) AS found FROM notes".format(*_AFTER), "notes")
_DAYS = "".join(V.WEEK_DAYS)
view("times", f"""
    SELECT id, list_concat(list_filter([{strings(V.TIME_WORDS)}], lambda w: contains(content, w)), list_concat(
      CASE WHEN regexp_matches(substr(content, instr(content, '周'), 2), '^周[{_DAYS}]$') THEN [substr(content, instr(content, '周'), 2)] ELSE [] END,
      CASE WHEN regexp_matches(substr(content, instr(content, '星期'), 3), '^星期[{_DAYS}]$') THEN [substr(content, instr(content, '星期'), 3)] ELSE [] END)) AS found
    FROM notes""", "notes")


def _found(expr):
    def run(spark, d):
        return A.cjk_notes(spark, d).select("id", F.array_join(F.array_sort(expr(F.col("content"))), "|").alias("found"))

    return run


def _found_sql(name):
    return with_views(name, f"SELECT id, array_to_string(list_sort(found), '|') AS found FROM {name}")


check("l1_extract_persons", _found_sql("persons"))(_found(entities.extract_persons))
check("l3_extract_times", _found_sql("times"))(_found(entities.extract_times))


@check("l2_extract_places", with_views("notes", f"""
    SELECT id, array_to_string(list_sort(list_distinct(list_concat(list_concat(
        regexp_extract_all(masked, '在({_CJK})', 1), regexp_extract_all(masked, '去({_CJK})', 1)), list_concat(
        regexp_extract_all(masked, '到({_CJK})', 1), regexp_extract_all(masked, '从({_CJK})', 1))))), '|') AS found
    FROM (SELECT id, regexp_replace(content, '{"|".join(V.TIME_WORDS)}', '#', 'g') AS masked FROM notes)"""))
def extract_places(spark, d):
    return _found(entities.extract_places)(spark, d)


@check("l4_write_narratives", with_views("notes", f"""
    SELECT id, CAST(p - 1 AS BIGINT) AS position, type, value FROM (
      SELECT id, type, value, row_number() OVER (PARTITION BY id ORDER BY k, i) AS p FROM (
        SELECT id, 'person' AS type, 1 AS k, unnest(v) AS value, generate_subscripts(v, 1) AS i FROM (SELECT id, CASE n WHEN 0 THEN ['小'] WHEN 4 THEN ['小'] WHEN 5 THEN ['小', '老'] ELSE [] END AS v FROM kinds)
        UNION ALL SELECT id, 'place', 2, unnest(v), generate_subscripts(v, 1) FROM (SELECT id, CASE n WHEN 0 THEN ['公'] WHEN 1 THEN ['旅'] WHEN 4 THEN ['北', '上'] WHEN 5 THEN ['南'] ELSE [] END AS v FROM kinds)
        UNION ALL SELECT id, 'time', 3, unnest(v), generate_subscripts(v, 1) FROM (SELECT id, CASE n WHEN 1 THEN ['去年'] WHEN 2 THEN ['周三'] WHEN 4 THEN ['昨天', '星期五'] WHEN 5 THEN ['今年'] ELSE [] END AS v FROM kinds)))
    """.replace("kinds)", f"(SELECT doc_id AS id, n_chars % {len(A.NOTES)} AS n FROM documents))")))
def write_narratives(spark, d):
    accepted, _ = N.write_narratives(A.cjk_notes(spark, d))
    return N.entity_rows(accepted).drop("image_id")


@check("l4_get_narratives", with_views("narratives", f"SELECT id, image_id, md5(content) AS digest, {stamp('created_at')} AS created_at FROM narratives WHERE image_id = 7"))
def get_narratives(spark, d):
    return N.get_narratives(A.narratives(spark, d), 7).select("id", "image_id", F.md5(F.col("content").cast("binary")).alias("digest"), shown())


# the same rules written for RE2
_PREFIX = V.SECRET_PREFIX
_RE_SECRET = f"(?i)({_PREFIX})(?:([A-Za-z0-9_-]{{4}})[A-Za-z0-9_-]{{3,56}}([A-Za-z0-9_-]{{4}})|[A-Za-z0-9_-]{{8,10}})"
_RE_ENC = "(?i)(enc:v[12]:)([A-Za-z0-9+/=]{4})[A-Za-z0-9+/=]{8,}([A-Za-z0-9+/=]{4})"
_RE_WIN = r"(?i)[A-Za-z]:\\(?:[^\s:\\/]+[\\/])*[^\s:\\/]*\.\w+"
_RE_UNIX = r"(?i)/(?:home|Users|tmp|var|opt|etc|srv)/(?:[^\s/]+)/[^\s]*"
_RE_URL = r"(?i)([?&](?:token|api_key|apikey|access_token|secret|password|auth|credential))=[^&\s\x22\x27]*"


def sanitize_sql(text):
    out = f"regexp_replace({text}, '{_RE_SECRET}', '\\1\\2****\\3', 'g')"
    out = f"regexp_replace({out}, '{_RE_ENC}', '\\1\\2****\\3', 'g')"
    for pattern in (_RE_WIN, _RE_UNIX):
        out = f"regexp_replace({out}, '{pattern}', '[REDACTED_PATH]', 'g')"
    return f"regexp_replace({out}, '{_RE_URL}', '\\1=[REDACTED]', 'g')"


_PLANTED = [
    "Bearer abcdefgh1234", "sk-12345678", "api_key = short", "password:12345678", "enc:v2:QUJDREVGR0hJSktMTU5PUA==",
    "C:\\Users\\me\\photo.jpg gone", "/home/me/pics/a.png gone", "see http://h/p?token=abc&x=1", "safe text", "SECRET: abcdefghijk",
]
_PLANT_SQL = f"list_extract([{strings(_PLANTED)}], CAST(n_chars % {len(_PLANTED)} AS INTEGER) + 1)"


def _planted():
    return F.get(F.array(*[F.lit(p) for p in _PLANTED]), (F.col("n_chars") % len(_PLANTED)).cast("int"))


@check("l5_sanitize_log", f"""
    SELECT doc_id, md5({sanitize_sql('text')}) AS digest, {sanitize_sql(_PLANT_SQL)} AS planted FROM documents""")
def sanitize_log(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.select(
        "doc_id",
        F.md5(redact.sanitize_log(F.col("text")).cast("binary")).alias("digest"),
        redact.sanitize_log(_planted()).alias("planted"),
    )


@check("l6_mask_redact", f"""
    SELECT page_id, CASE WHEN strlen(url) <= 10 THEN '****' ELSE left(url, 4) || '****' || right(url, 4) END AS masked,
      regexp_replace(url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'Token=s3cret&x=1', '{_RE_URL}', '\\1=[REDACTED]', 'g') AS url,
      CASE WHEN page_id % 2 = 0 THEN '[REDACTED_PATH]' ELSE '/srv' END AS path FROM pages""")
def mask_redact(spark, d):
    pages = A.table(spark, d, "pages")
    joiner = F.when(F.contains("url", F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/srv/www/"), "url")).otherwise(F.lit("/srv"))
    return pages.select(
        "page_id",
        redact.mask_value(F.col("url")).alias("masked"),
        redact.redact_url(F.concat("url", joiner, F.lit("Token=s3cret&x=1"))).alias("url"),
        redact.redact_path(path).alias("path"),
    )


@check("l7_sanitize_error", r"""
    SELECT page_id, regexp_replace(regexp_replace(m, '(?i)(?:[A-Za-z]:\\|/)(?:[^\s:\\/]+[\\/])+[^\s:\\/]*', '[PATH]', 'g'),
      '(?i)\b(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|PRAGMA)\b.+?(?:;|$)', '[QUERY]', 'g') AS message
    FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'cannot open ' || url WHEN page_id % 3 = 1 THEN 'near "select x from y; drop z" in ' || url
      ELSE 'C:\a\b.txt failed: UPDATE t SET a = 1' END AS m FROM pages)""")
def sanitize_error(spark, d):
    third = F.col("page_id") % 3
    message = (
        F.when(third == 0, F.concat(F.lit("cannot open "), "url"))
        .when(third == 1, F.concat(F.lit('near "select x from y; drop z" in '), "url"))
        .otherwise(F.lit("C:\\a\\b.txt failed: UPDATE t SET a = 1"))
    )
    return A.table(spark, d, "pages").select("page_id", redact.sanitize_error(message).alias("message"))
