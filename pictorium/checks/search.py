"""Inverted-index search and narrative search."""

from __future__ import annotations

from pyspark.sql import functions as F

from pictorium.functions.segment import dictionary, weight_of
from pictorium.functions.text import tokenize
from pictorium.operators import index as X
from pictorium.operators import search as S
from pictorium.operators import substring_index
from pictorium.plans.scratch import new_path
from pictorium.sources import adapters as A

from .registry import STOP, check, tokens, with_views

_RANK = "relevance_score DESC, match_count DESC, created_at DESC, id DESC"


def hits(terms: str, where: str = "TRUE") -> str:
    return f"""SELECT a.id, a.created_at, count(DISTINCT p.term) AS match_count, sum(p.weight) AS relevance_score
      FROM postings p JOIN assets a ON a.id = p.image_id
      WHERE p.term IN ({terms}) AND a.ai_status = 'completed' AND {where} GROUP BY a.id, a.created_at"""


@check("e1_tokenize", f"""
    SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest
    FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)""")
def tokenized(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", tokenize(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@check("e2_build_index", with_views("postings", "SELECT image_id, term, field, weight FROM postings"))
def build_index(spark, d):
    return S.build_index(A.assets(spark, d)).select("image_id", "term", "field", "weight")


#: A small frequency dictionary with overlapping words for the notes of the library.
CHINESE_WORDS = {
    "我": 900, "和": 800, "小明": 60, "明一": 3, "一起": 200, "起去": 5, "公园": 90, "去年": 120, "年我": 4, "我们": 400, "们去": 6, "旅行": 70,
    "周三": 50, "三开": 2, "开会": 80, "一张": 150, "张风": 2, "风景": 90, "风景照": 20, "景照": 5, "照": 30, "星期": 90, "星期五": 60, "期五": 3,
    "小红": 60, "红在": 2, "北京": 200, "吃饭": 100, "昨天": 110, "天到": 6, "上海": 180, "到上": 9, "今年": 130, "南京": 100, "京走": 2,
    "老王": 60, "小李": 60, "王和": 3, "和小": 12,
}
_LONGEST = max(map(len, CHINESE_WORDS))
_TOTAL = sum(CHINESE_WORDS.values())


def best_route(text: str) -> str:
    """SQL of the words of an ideograph run: from its end backwards the best of all words at each position, ties to the longer."""
    weights = ", ".join(f"'{w}': {weight_of(f, _TOTAL)}" for w, f in CHINESE_WORDS.items())
    return f"""list_reduce(list_prepend([{{'s': 0, 'n': 0, 'w': CAST([] AS VARCHAR[])}}],
      list_transform(range(length({text}), 0, -1), lambda i: [{{'s': i, 'n': 0, 'w': [{text}]}}])),
      lambda routes, pos: list_prepend(list_max(list_filter(list_transform(range(1, least({_LONGEST}, len(routes)) + 1),
        lambda k: {{'s': coalesce(map_extract_value(MAP {{{weights}}}, substr(pos[1].w[1], pos[1].s, k)), CASE WHEN k = 1 THEN {weight_of(1, _TOTAL)} END) + routes[k].s,
          'n': k, 'w': list_prepend(substr(pos[1].w[1], pos[1].s, k), routes[k].w)}}), lambda r: r.s IS NOT NULL)), routes))[1].w"""


_HAN = r"[\x{4E00}-\x{9FFF}]"


@check("e1_tokenize_chinese", with_views("notes", rf"""
    SELECT id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (
      SELECT id, list_filter(flatten(list_transform(regexp_extract_all(lower(content), '{_HAN}+|[\p{{L}}\p{{N}}]+'),
        lambda x: CASE WHEN regexp_matches(x, '^{_HAN}') THEN {best_route("x")} ELSE [x] END)),
        lambda t: strlen(t) > 1 AND NOT list_contains([{STOP}], t)) AS t FROM notes)"""))
def tokenized_chinese(spark, d):
    words = dictionary(CHINESE_WORDS)
    notes = A.cjk_notes(spark, d).select("id", tokenize(F.col("content"), words).alias("t"))
    return notes.select("id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@check("e3_search", with_views("assets, postings", f"""
    SELECT h.id, a.file_path, a.ai_category, h.match_count, h.relevance_score
    FROM (SELECT * FROM ({hits("'thre', 'src12', 'clean', 'ouier'")}) ORDER BY {_RANK} LIMIT 20) h
    JOIN assets a ON a.id = h.id"""))
def search(spark, d):
    assets = A.assets(spark, d)
    out = S.search(S.build_index(assets), assets, "Thre, the src12! clean OUIER", 20)
    return out.select("id", "file_path", "ai_category", "match_count", "relevance_score")


def _stored(spark, assets):
    return X.create_index(assets, new_path(spark, "search-index"), bits=6)


@check("e3_search_blocks", with_views("assets, postings", f"""
    SELECT h.id, a.file_path, a.ai_category, h.match_count, h.relevance_score
    FROM (SELECT * FROM ({hits("'the', 'clean', 'and'")}) ORDER BY {_RANK} LIMIT 15 OFFSET 5) h
    JOIN assets a ON a.id = h.id"""))
def search_blocks(spark, d):
    """Terms that most assets hold: the page comes from the newest buckets."""
    assets = A.assets(spark, d)
    out = X.search_index(_stored(spark, assets), assets, "the clean, AND", 15, 5, words=[], waves=(2, 4))
    return out.select("id", "file_path", "ai_category", "match_count", "relevance_score")


@check("e3_search_filtered", with_views("assets, postings", f"""
    SELECT id, match_count, relevance_score FROM ({hits("'the', 'src1', 'clean'",
      "a.ai_category = 'en' AND contains(array_to_string(a.ai_tags, '|'), 'src1') AND a.created_at >= TIMESTAMP '2024-01-01' AND a.created_at <= TIMESTAMP '2024-01-01 12:00:00'")})
    ORDER BY {_RANK} LIMIT 10 OFFSET 5"""))
def search_filtered(spark, d):
    assets = A.assets(spark, d)
    out = S.search(
        S.build_index(assets), assets, "the src1 clean", 10, 5, category="en", tags=["src1"], start="2024-01-01", end="2024-01-01 12:00:00"
    )
    return out.select("id", "match_count", "relevance_score")


@check("e3_search_many", with_views("assets, postings", f"""
    WITH asked AS (SELECT DISTINCT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark),
    scored AS (SELECT q.query_id, a.id, a.created_at, count(DISTINCT p.term) AS match_count, sum(p.weight) AS relevance_score
      FROM asked q JOIN postings p ON p.term = q.term JOIN assets a ON a.id = p.image_id
      WHERE a.ai_status = 'completed' GROUP BY 1, 2, 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_RANK}) AS rank FROM scored)
    SELECT query_id, id, rank, match_count, relevance_score FROM ranked WHERE rank <= 10"""))
def search_many(spark, d):
    assets = A.assets(spark, d)
    queries = A.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    out = S.search_many(S.build_index(assets), assets, queries, 10)
    return out.withColumn("rank", F.col("rank").cast("long"))


def fallback(page: str, query: str, size: int) -> str:
    return f"""WITH page AS (SELECT * FROM ({page}) ORDER BY {_RANK} LIMIT {size}),
    told AS (SELECT image_id AS id, max(created_at) AS told_at FROM narratives WHERE contains(lower(content), '{query}') GROUP BY 1),
    extra AS (SELECT id, CAST(1 AS BIGINT) AS match_count, CAST(0.5 AS DOUBLE) AS relevance_score, told_at AS created_at, 1 AS stage FROM told
      WHERE id NOT IN (SELECT id FROM page) AND id IN (SELECT id FROM assets) ORDER BY told_at DESC, id DESC LIMIT {size})
    SELECT id, match_count, relevance_score, CAST(stage AS BIGINT) AS stage
    FROM (SELECT id, match_count, relevance_score, created_at, 0 AS stage FROM page UNION ALL SELECT * FROM extra)
    ORDER BY stage, {_RANK} LIMIT {size}"""


@check("e4_search_with_fallback", with_views(
    "assets, postings, narratives", fallback(hits("'src12', 'therha'", "list_contains(a.ai_tags, 'clean')"), "src12 therha", 20)))
def search_with_fallback(spark, d):
    assets = A.assets(spark, d)
    out = S.search_with_fallback(
        S.build_index(assets), assets, A.narratives(spark, d), "src12 therha", 0, 20, tags=["clean"]
    )
    return out.select("id", "match_count", "relevance_score", F.col("stage").cast("long").alias("stage"))


@check("e4_narrative_fallback", with_views("assets, postings, narratives", fallback(hits("'erth'", "a.source = 'src8'"), "erth", 30)))
def narrative_fallback(spark, d):
    assets = A.assets(spark, d)
    index = S.build_index(assets.filter("source = 'src8'"))
    out = S.search_with_fallback(index, assets, A.narratives(spark, d), "erth", 0, 30)
    return out.select("id", "match_count", "relevance_score", F.col("stage").cast("long").alias("stage"))


ASSOCIATIONS = with_views("assets, narratives", """
    SELECT n.id, n.image_id, a.file_name, 'content' AS match_type, CAST(1.0 AS DOUBLE) AS relevance
    FROM narratives n JOIN assets a ON a.id = n.image_id WHERE contains(lower(n.content), 'and the')
    ORDER BY n.created_at DESC, n.id DESC LIMIT 20""")


@check("e5_query_associations", ASSOCIATIONS)
def query_associations(spark, d):
    out = S.query_associations(A.narratives(spark, d), A.assets(spark, d), "AND the")
    return out.select("id", "image_id", "file_name", "match_type", "relevance")


@check("e5_indexed_associations", ASSOCIATIONS)
def indexed_associations(spark, d):
    """The same by a stored substring index of the narratives."""
    told, path = A.narratives(spark, d), new_path(spark, "substrings")
    substring_index.append_texts(S.narrative_texts(told), path)
    out = S.query_associations(S.indexed_narrative_matches(told, path, "AND the"), A.assets(spark, d), "AND the")
    return out.select("id", "image_id", "file_name", "match_type", "relevance")


REFRESHED = with_views("assets, postings", """
    SELECT image_id, count(*) AS n_terms, sum(weight) AS weight FROM (
      SELECT image_id, term, weight FROM postings WHERE image_id NOT IN (SELECT id FROM assets WHERE source IN ('src1', 'src2'))
      UNION ALL
      SELECT id, term, CAST(CASE WHEN list_contains(['renamed'], term) THEN 2.0 ELSE 1.0 END AS DOUBLE) FROM
        (SELECT id, unnest(list_distinct(list_concat(list_concat(['short', 'note', 'renamed'], CASE WHEN ai_category IS NULL THEN [] ELSE [ai_category] END),
           list_concat(['id'], CASE WHEN strlen(CAST(id AS VARCHAR)) > 1 THEN [CAST(id AS VARCHAR)] ELSE [] END)))) AS term
         FROM assets WHERE source = 'src1' AND ai_tag_status <> 'rejected'))
    GROUP BY image_id""")


@check("e6_refresh_index", REFRESHED)
def refresh_index(spark, d):
    assets = A.assets(spark, d)
    fresh = S.refresh_index(S.build_index(assets), changed_assets(assets))
    return _summary(fresh)


@check("e6_index_segments", REFRESHED)
def index_segments(spark, d):
    """The same change as three updates of a stored index with a merge in between."""
    assets = A.assets(spark, d)
    index, changed = _stored(spark, assets), changed_assets(assets)
    index = X.update_index(index, assets.filter(F.col("source") == "src2"))
    index = X.remove_from_index(index, changed.filter(F.col("ai_tag_status") == "rejected").select("id"))
    index = X.update_index(X.merge_index(spark, index, fan=2), changed)
    return _summary(X.live_postings(spark, index))


def _summary(postings):
    return postings.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("weight").alias("weight"))


def changed_assets(assets):
    return (
        assets.filter(F.col("source").isin("src1", "src2"))
        .withColumn("ai_description", F.lit("A short note"))
        .withColumn("ai_tags", F.array(F.lit("Renamed")))
        .withColumn("ai_tag_status", F.when(F.col("source") == "src2", F.lit("rejected")).otherwise(F.col("ai_tag_status")))
    )
