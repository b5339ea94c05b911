"""Registry of checked queries and the SQL views they share."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from pictorium.functions import fixed_values as V

Query = Callable[[SparkSession, str], DataFrame]


class Entry(NamedTuple):
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def check(name: str, sql: str | None = None):
    """Register a query with the SQL a plain database runs for it."""

    def add(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"{name} is registered twice")
        ENTRIES[name] = Entry(run, sql)
        return run

    return add


def strings(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


STOP = strings(dict.fromkeys(V.STOP_WORDS))


def tokens(text: str) -> str:
    """SQL of the search tokens (texts without ideographs)."""
    return (
        rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+'), "
        f"lambda t: strlen(t) > 1 AND NOT list_contains([{STOP}], t))"
    )


def grade_sql(conf: str) -> str:
    return f"CASE WHEN {conf} >= 0.85 THEN 'verified' WHEN {conf} >= 0.5 THEN 'provisional' ELSE 'rejected' END"


VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (list(needs), sql)


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``body`` below a WITH clause of the named views and what they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.replace(",", " ").split():
        visit(name)
    clauses = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in ordered)
    head = "WITH RECURSIVE" if recursive else "WITH"
    body = body.strip()
    if body.upper().split()[0] == "WITH":
        body = ", " + body[4:]
    return f"{head} {clauses}\n{body}"


view(
    "assets",
    f"""
    SELECT d.doc_id AS id,
      '/lib/' || d.source || '/' || d.doc_id || '.' || d.lang AS file_path,
      d.doc_id || '.' || d.lang AS file_name,
      d.n_chars AS file_size,
      sha256(d.text) AS file_hash,
      CAST(640 + 160 * (d.doc_id % 7) AS INTEGER) AS width,
      CAST(480 + 120 * (d.doc_id % 5) AS INTEGER) AS height,
      CASE WHEN d.source IN ('src3', 'src11') THEN 'failed'
           WHEN d.source IN ('src5', 'src17') THEN 'pending' ELSE 'completed' END AS ai_status,
      CASE WHEN l.toxic = 0 THEN [d.lang, d.source, 'clean'] ELSE [d.lang, d.source] END AS ai_tags,
      d.text AS ai_description,
      CASE WHEN d.source <> 'src9' THEN d.lang END AS ai_category,
      ((d.doc_id * 37) % 100) / CAST(100 AS DOUBLE) AS ai_confidence,
      CASE WHEN d.source NOT IN ('src3', 'src11', 'src5', 'src17')
           THEN TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id % 30 AS INTEGER)) END AS ai_processed_at,
      CASE WHEN d.source IN ('src3', 'src11') THEN 'timeout' END AS ai_error_message,
      CAST(CASE WHEN d.source IN ('src3', 'src11') THEN d.doc_id % 5 ELSE 0 END AS INTEGER) AS ai_retry_count,
      d.source AS source,
      TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS created_at,
      CASE WHEN d.lang = 'de' THEN 'generator' END AS generation_source,
      {grade_sql("((d.doc_id * 37) % 100) / CAST(100 AS DOUBLE)")} AS ai_tag_status
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    """,
)
view(
    "all_terms",
    f"""
    SELECT id AS image_id, list_transform(ai_tags, lambda t: lower(t)) AS tags,
      unnest(list_distinct(list_concat(list_concat({tokens("coalesce(ai_description, '')")},
        list_transform(ai_tags, lambda t: lower(t))),
        list_concat({tokens("coalesce(ai_category, '')")}, {tokens("'id ' || id")})))) AS term
    FROM assets WHERE ai_tag_status IS DISTINCT FROM 'rejected'
    """,
    "assets",
)
view(
    "postings",
    """
    SELECT image_id, term, CAST(CASE WHEN list_contains(tags, term) THEN 2.0 ELSE 1.0 END AS DOUBLE) AS weight,
      'combined' AS field FROM all_terms
    """,
    "all_terms",
)
view(
    "buckets",
    r"""
    SELECT doc_id AS id, list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'),
      lambda t: CAST('0x' || substr(md5(t), 1, 2) AS INTEGER) % 64) AS b FROM documents
    """,
)
view(
    "prints64",
    """
    SELECT id, list_reduce(list_transform(range(0, 64),
        lambda i: CAST(CASE WHEN len(list_filter(b, lambda x: x = i)) * 64 >= len(b) THEN 1 ELSE 0 END AS UBIGINT)),
      lambda acc, x: CAST(acc * 2 + x AS UBIGINT)) AS u FROM buckets
    """,
    "buckets",
)


def signed(u: str) -> str:
    return (
        f"CAST(CASE WHEN {u} >= 9223372036854775808 THEN CAST({u} AS HUGEINT) - 18446744073709551616 "
        f"ELSE CAST({u} AS HUGEINT) END AS BIGINT)"
    )


view(
    "prints",
    f"SELECT p.id, p.u, {signed('p.u')} AS word FROM prints64 p JOIN assets a ON a.id = p.id WHERE a.ai_status = 'completed'",
    "prints64",
    "assets",
)
view(
    "cal_samples",
    """
    SELECT l.doc_id AS id, d.lang AS predicted_category,
      ((l.doc_id * 37) % 100) / CAST(100 AS DOUBLE) AS confidence, l.quality = 1 AS is_correct
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id
    """,
)
view(
    "narratives",
    """
    SELECT conv_id * 1000 + turn AS id, conv_id AS image_id, text AS content,
      TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS created_at
    FROM conversations WHERE role = 'user'
    """,
)
view(
    "log_lines",
    """
    SELECT event_id + 1 AS seq,
      CASE WHEN event_type = 'signup' THEN 'signup ' || user_id
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' ||
        CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN '{WARN}' ELSE 'INFO' END ||
        ' user.' || user_id || ' ' || event_type || ' props=' || props END AS line
    FROM events
    """,
)
view("error_events", "SELECT 'u' || user_id AS pattern_name, ts FROM events WHERE event_type = 'error'")
view(
    "attempts",
    "SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS item, ts, event_type = 'purchase' AS ok FROM events",
)
view(
    "corrections",
    """
    SELECT id, id AS image_id, ai_tags AS old_tags, list_append(ai_tags, 'fixed') AS new_tags, created_at AS corrected_at
    FROM assets WHERE source IN ('src1', 'src2', 'src3', 'src4')
    """,
    "assets",
)


def stamp(column: str) -> str:
    """Timestamp as text, equal to Spark's ``yyyy-MM-dd HH:mm:ss``."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
