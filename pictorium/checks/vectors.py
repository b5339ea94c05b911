"""Vector table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pictorium.functions import vectors as fv
from pictorium.operators import similarity as K
from pictorium.operators import vector_index
from pictorium.plans.scratch import new_path
from pictorium.sources import adapters as A

from .registry import check, view, with_views

view("vecs", "SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings")
view("sims", """
    SELECT q.id AS query_id, b.id AS id, list_cosine_similarity(q.v, b.v) AS s, b.label AS label, q.label AS q_label FROM vecs q JOIN vecs b ON q.id <> b.id""", "vecs")


@check("k1_insert_vectors", """
    SELECT CAST(vec_id AS VARCHAR) AS id, label AS version, 'kept' AS state FROM embeddings WHERE label >= 5
    UNION ALL SELECT CAST(vec_id AS VARCHAR), 100, 'kept' FROM embeddings WHERE label < 5
    UNION ALL SELECT CAST(vec_id AS VARCHAR), 100, 'refused' FROM embeddings WHERE label BETWEEN 5 AND 6
    UNION ALL SELECT CAST(vec_id AS VARCHAR), 100, 'refused' FROM embeddings WHERE label = 7""")
def insert_vectors(spark, d):
    base = A.vectors(spark, d).select(F.col("id").cast("string").alias("id"), "embedding", F.col("label").cast("int").alias("version"))
    cut = F.when(F.col("version") < 5, F.col("embedding")).when(F.col("version") == 7, F.slice("embedding", 1, 0)).otherwise(F.slice("embedding", 1, 3))
    new = base.filter("version <= 7").select("id", cut.alias("embedding"), F.lit(100).alias("version"))
    table, refused = K.insert_vectors(base, new, 64, "version")
    kept = table.select("id", "version", F.lit("kept").alias("state"))
    return kept.unionByName(refused.select("id", "version", F.lit("refused").alias("state")))


def _no_self(df):
    return df.filter("query_id <> id")


@check("k2_cosine_topk", with_views("vecs", """
    SELECT query_id, id, round(s, 6) AS similarity, rank FROM (
      SELECT q.id AS query_id, b.id AS id, list_cosine_similarity(q.v, b.v) AS s,
        row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, b.v), 9) DESC, b.id) AS rank
      FROM vecs q JOIN vecs b ON list_cosine_similarity(q.v, b.v) >= 0.2) WHERE rank <= 5"""))
def cosine_topk(spark, d):
    base = A.vectors(spark, d)
    queries = base.withColumnRenamed("id", "query_id")
    out = K.search_vectors(queries, base, 5, 0.2)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@check("k2_cosine_topk_blocks", with_views("vecs", """
    SELECT query_id, id, round(s, 6) AS similarity, rank FROM (
      SELECT q.id AS query_id, b.id AS id, list_cosine_similarity(q.v, b.v) AS s,
        row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, b.v), 9) DESC, b.id) AS rank
      FROM vecs q JOIN vecs b ON list_cosine_similarity(q.v, b.v) >= 0.3) WHERE rank <= 3"""))
def cosine_topk_blocks(spark, d):
    base = A.vectors(spark, d)
    out = K.search_vectors(base.withColumnRenamed("id", "query_id"), base, 3, 0.3, max_numbers=1, block=256)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@check("k2_stored_index", with_views("vecs", """
    SELECT query_id, id, round(s, 6) AS similarity, rank FROM (
      SELECT q.id AS query_id, b.id AS id, list_cosine_similarity(q.v, b.v) AS s,
        row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, b.v), 9) DESC, b.id) AS rank
      FROM vecs q JOIN vecs b ON list_cosine_similarity(q.v, b.v) >= 0.2) WHERE rank <= 4"""))
def stored_index(spark, d):
    """All vectors asked of a stored index that was written in two batches."""
    base, path = A.vectors(spark, d), new_path(spark, "vector-index")
    early = F.pmod(F.xxhash64("id"), F.lit(4)) > 0
    vector_index.write_vector_index(base.filter(early), path, 64)
    vector_index.append_vectors(base.filter(~early), path)
    out, _ = vector_index.search_index(base.withColumnRenamed("id", "query_id"), path, 4, 0.2)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


# lengths of 64, 40 and 0, and zero vectors
view("mixed", """
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN list_transform(e, lambda x: x * 0) WHEN vec_id % 5 = 0 THEN e[1:40] WHEN vec_id % 11 = 0 THEN [] ELSE e END AS v
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
view("mixed_sims", """
    SELECT q.id AS query_id, b.id, CASE WHEN len(q.v) = len(b.v) AND len(q.v) > 0 AND list_sum(list_transform(q.v, lambda x: x * x)) > 0
      AND list_sum(list_transform(b.v, lambda x: x * x)) > 0 THEN list_cosine_similarity(q.v, b.v) ELSE 0 END AS s
    FROM mixed q JOIN mixed b ON q.id % 10 < 4""", "mixed")


@check("k2_cosine_topk_mixed_lengths", with_views("mixed_sims", """
    SELECT query_id, id, round(s, 6) AS similarity, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM mixed_sims WHERE s >= 0) WHERE rank <= 300"""))
def cosine_topk_mixed_lengths(spark, d):
    e = F.col("embedding")
    v = F.when(F.col("id") % 7 == 0, F.transform(e, lambda x: x * 0)).when(F.col("id") % 5 == 0, F.slice(e, 1, 40)).when(F.col("id") % 11 == 0, F.slice(e, 1, 0)).otherwise(e)
    base = A.vectors(spark, d).select("id", v.alias("embedding"))
    out = K.search_vectors(base.filter("id % 10 < 4").withColumnRenamed("id", "query_id"), base, 300, 0.0, tile=128)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@check("k3_cosine", with_views("vecs", """
    SELECT a.id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity, CAST(0 AS DOUBLE) AS mismatch FROM vecs a JOIN vecs b ON b.id = a.id + 1"""))
def cosine(spark, d):
    a = A.vectors(spark, d)
    b = a.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return a.join(b, "id").select(
        "id",
        F.round(fv.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"),
        fv.cosine(F.col("embedding"), F.slice("other", 1, 10)).alias("mismatch"),
    )


@check("k4_delete_vector", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id <> 17")
def delete_vector(spark, d):
    return K.delete_vector(A.vectors(spark, d), 17).select("id", "label")


@check("k5_vector_stats", """
    SELECT count(*) AS total_vectors, CAST(64 AS BIGINT) AS dimension, CAST(sum(len(embedding) * 4 + strlen(CAST(vec_id AS VARCHAR))) AS BIGINT) AS size_bytes FROM embeddings""")
def vector_stats(spark, d):
    return K.vector_stats(A.vectors(spark, d), 64)


@check("k6_match_registered", with_views("vecs", """
    SELECT q.id AS query_id, m.id AS match_id, round(m.s, 6) AS similarity, (SELECT count(*) FROM vecs WHERE label < 3) AS registered
    FROM vecs q LEFT JOIN (
      SELECT q.id AS qid, b.id, list_cosine_similarity(q.v, b.v) AS s,
        row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, b.v), 9) DESC, b.id) AS rn
      FROM vecs q JOIN vecs b ON b.label < 3 WHERE q.label >= 3 AND list_cosine_similarity(q.v, b.v) >= 0.3) m ON m.qid = q.id AND m.rn = 1
    WHERE q.label >= 3"""))
def match_registered(spark, d):
    base = A.vectors(spark, d)
    registry = base.filter("label < 3")
    queries = base.filter("label >= 3").withColumnRenamed("id", "query_id")
    count = registry.agg(F.count(F.lit(1))).scalar()
    out = K.match_registered(queries, registry, 0.3)
    return out.select("query_id", "match_id", F.round("similarity", 6).alias("similarity"), count.alias("registered"))


@check("k7_text_vectors", r"""
    WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents),
    h AS (SELECT id, CAST('0x' || substr(md5(token), 1, 4) AS INTEGER) % 512 AS i, CASE WHEN CAST('0x' || substr(md5(token), 5, 1) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END AS s FROM t),
    c AS (SELECT id, i, sum(s) AS total FROM h GROUP BY 1, 2 HAVING sum(s) <> 0)
    SELECT id, CAST(i AS BIGINT) AS index, round(total / sqrt(sum(CAST(total AS DOUBLE) * total) OVER (PARTITION BY id)), 6) AS value FROM c""")
def text_vectors(spark, d):
    docs = A.table(spark, d, "documents")
    return K.text_vectors(docs, "doc_id", "text").withColumn("value", F.round("value", 6))


@check("k7_text_vectors_dense", r"""
    WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents),
    s AS (SELECT id, CAST('0x' || substr(md5(token), 1, 4) AS INTEGER) % 512 AS i, sum(CASE WHEN CAST('0x' || substr(md5(token), 5, 1) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END) AS n FROM t GROUP BY ALL),
    l AS (SELECT *, sqrt(sum(CAST(n AS DOUBLE) * n) OVER (PARTITION BY id)) AS length FROM s WHERE n <> 0)
    SELECT id, CAST(512 AS BIGINT) AS dimension, count(*) AS n_filled, round(sum(CAST(CAST(n / length AS FLOAT) AS DOUBLE) * (i + 1)), 5) AS weighted, round(sum(CAST(CAST(n / length AS FLOAT) AS DOUBLE) ** 2), 7) AS square FROM l GROUP BY id""")
def text_vectors_dense(spark, d):
    dense = K.dense_text_vectors(K.text_vectors(A.table(spark, d, "documents"), "doc_id", "text"))
    # sums that change with any value or place
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    square = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x), F.lit(0.0), lambda acc, x: acc + x)
    n = F.size(F.filter("embedding", lambda x: x != 0)).cast("long")
    return dense.select("id", F.size("embedding").cast("long").alias("dimension"), n.alias("n_filled"), F.round(weighted, 5).alias("weighted"), F.round(square, 7).alias("square"))
