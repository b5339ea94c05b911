"""Ingest, hashing and near-duplicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pictorium.functions import files, hashing
from pictorium.operators import dedup as D
from pictorium.operators import fingerprint_index
from pictorium.operators import ingest
from pictorium.plans.scratch import Scratch, new_path
from pictorium.plans.skew import shuffled
from pictorium.sources import adapters as A
from pictorium.sources import sinks

from .registry import check, signed, strings, view, with_views

RADIUS = 6

view("incoming", """
    SELECT doc_id AS seq, CASE WHEN source = 'src8' THEN '/in/../' ELSE '/in/' END || source || '/' || doc_id || '.' ||
        CASE lang WHEN 'en' THEN 'jpg' WHEN 'fr' THEN 'png' WHEN 'de' THEN 'gif' WHEN 'es' THEN 'svg' ELSE 'bin' END AS path,
      CASE lang WHEN 'en' THEN 'jpg' WHEN 'fr' THEN 'png' WHEN 'de' THEN 'gif' WHEN 'es' THEN 'svg' ELSE 'bin' END AS ext,
      CASE WHEN source = 'src9' THEN ''::BLOB ELSE
        (CASE WHEN source = 'src7' THEN '\\x00\\x00\\x00\\x00'::BLOB
         ELSE CASE lang WHEN 'en' THEN '\\xFF\\xD8\\xFF\\xE0'::BLOB WHEN 'fr' THEN '\\x89\\x50\\x4E\\x47\\x0D\\x0A\\x1A\\x0A'::BLOB
              WHEN 'de' THEN 'GIF89a'::BLOB WHEN 'es' THEN '<svg'::BLOB ELSE '\\x00\\x00\\x00\\x00'::BLOB END END) || encode(text) END AS content
    FROM documents""")
view("validated", """
    SELECT seq, path, octet_length(content) AS length, sha256(content) AS file_hash,
      CASE WHEN contains(path, '..') THEN 'encoded_traversal'
           WHEN octet_length(content) = 0 THEN 'empty'
           WHEN octet_length(content) > 52428800 THEN 'too_large'
           WHEN ext NOT IN ('jpg', 'png', 'gif') THEN 'unsupported_extension'
           WHEN NOT CASE ext WHEN 'jpg' THEN starts_with(hex(content), 'FFD8FF') WHEN 'png' THEN starts_with(hex(content), '89504E470D0A1A0A')
                ELSE starts_with(hex(content), '474946') END THEN 'magic_mismatch' END AS reason,
      CASE ext WHEN 'jpg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'gif' THEN 'image/gif' ELSE 'application/octet-stream' END AS mime_type
    FROM incoming""", "incoming")
# a tenth of the library counts as stored already
view("stored", "SELECT DISTINCT file_hash FROM validated WHERE path LIKE '/in/src1/%' OR path LIKE '/in/src2/%'", "validated")
view("outcomes", """
    SELECT seq, path, length, CASE WHEN reason IS NOT NULL THEN 'error'
      WHEN file_hash IN (SELECT file_hash FROM stored) THEN 'duplicate'
      WHEN row_number() OVER (PARTITION BY reason IS NULL, file_hash ORDER BY seq) > 1 THEN 'duplicate' ELSE 'success' END AS outcome
    FROM validated""", "validated", "stored")


def _stored(incoming):
    known = incoming.filter(F.col("path").like("/in/src1/%") | F.col("path").like("/in/src2/%"))
    return ingest.hash_content(known).select("file_hash").distinct()


@check("c1_validate_asset", with_views("validated", "SELECT seq, path, length, reason, mime_type FROM validated"))
def validate_asset(spark, d):
    return ingest.validate_assets(A.incoming_files(spark, d)).select("seq", "path", "length", "reason", "mime_type")


_HEADS = {
    "jpg": "FFD8FFE000", "jpeg": "FFD8FFDB", "png": "89504E470D0A1A0A00", "gif": "4749463839", "webp": "524946460000000057454250", "bmp": "424D0000",
    "ico": "0000010001", "tiff": "49492A0000", "tif": "4D4D002A00", "avif": "000000006674797061766966", "txt": "41424344",
}
_NAMES = list(_HEADS)
_OK = {
    "jpg": "h LIKE 'FFD8FF%'", "jpeg": "h LIKE 'FFD8FF%'", "png": "h LIKE '89504E470D0A1A0A%'", "gif": "h LIKE '474946%'",
    "webp": "h LIKE '52494646________57454250%'", "bmp": "h LIKE '424D%'", "ico": "h LIKE '00000100%'",
    "tiff": "h LIKE '49492A00%' OR h LIKE '4D4D002A%'", "tif": "h LIKE '49492A00%' OR h LIKE '4D4D002A%'", "avif": "h LIKE '________6674797061766966%'",
}


@check("c2_magic_ok", f"""
    SELECT doc_id, CASE ext {' '.join(f"WHEN '{e}' THEN ({c})" for e, c in _OK.items())} ELSE TRUE END AS magic_ok FROM
      (SELECT doc_id, list_extract([{strings(_NAMES)}], CAST(doc_id % 11 AS INTEGER) + 1) AS ext,
         list_extract([{strings(_HEADS.values())}], CAST(n_chars % 11 AS INTEGER) + 1) || hex(encode(text)) AS h FROM documents)""")
def magic_ok(spark, d):
    docs = A.table(spark, d, "documents")
    ext = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("doc_id") % 11).cast("int"))
    head = F.get(F.array(*[F.lit(h) for h in _HEADS.values()]), (F.col("n_chars") % 11).cast("int"))
    rows = docs.select("doc_id", ext.alias("ext"), F.concat(F.unhex(head), F.col("text").cast("binary")).alias("content"))
    return rows.select("doc_id", files.magic_ok(F.col("content"), F.col("ext")).alias("magic_ok"))


@check("c3_mime_from_ext", """
    SELECT page_id, CASE WHEN ext = 'html' THEN 'application/octet-stream' WHEN ext = '' THEN 'application/octet-stream' ELSE 'application/octet-stream' END AS mime_type, ext
    FROM (SELECT page_id, lower(regexp_extract(url, '[^/\\\\]\\.([^./\\\\]*)$', 1)) AS ext FROM pages)
    UNION ALL SELECT -1 - doc_id, CASE lang WHEN 'en' THEN 'image/jpeg' WHEN 'fr' THEN 'image/tiff' ELSE 'image/x-icon' END,
      CASE lang WHEN 'en' THEN 'jpeg' WHEN 'fr' THEN 'tif' ELSE 'ico' END FROM documents""")
def mime_from_ext(spark, d):
    pages = A.table(spark, d, "pages").select("page_id", files.extension(F.col("url")).alias("ext"))
    ext = F.when(F.col("lang") == "en", F.lit("JPEG")).when(F.col("lang") == "fr", F.lit("TIF")).otherwise(F.lit("Ico"))
    docs = A.table(spark, d, "documents").select((-1 - F.col("doc_id")).alias("page_id"), files.extension(F.concat(F.lit("/a.b/x."), ext)).alias("ext"))
    return pages.unionByName(docs).select("page_id", files.mime_from_extension(F.col("ext")).alias("mime_type"), "ext")


@check("c4_content_sha256", "SELECT doc_id, sha256(text) AS file_hash FROM documents")
def content_sha256(spark, d):
    return A.table(spark, d, "documents").select("doc_id", hashing.content_sha256(F.col("text")).alias("file_hash"))


@check("c5_exact_dedup", """
    SELECT doc_id AS seq FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
    WHERE rn = 1 AND text NOT IN (SELECT text FROM benchmark)""")
def exact_dedup(spark, d):
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), hashing.content_sha256(F.col("text")).alias("file_hash"))
    known = A.table(spark, d, "benchmark").select(hashing.content_sha256(F.col("text")).alias("file_hash"))
    return ingest.exact_dedup(docs, known).select("seq")


@check("c6_import_summary", with_views("outcomes", "SELECT outcome, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM outcomes GROUP BY 1"))
def import_summary(spark, d):
    incoming = A.incoming_files(spark, d)
    return ingest.import_summary(ingest.import_outcomes(incoming, _stored(incoming)))


@check("c6_import_outcomes", with_views("outcomes", "SELECT seq, path, outcome FROM outcomes"))
def import_outcomes(spark, d):
    incoming = A.incoming_files(spark, d)
    return ingest.import_outcomes(incoming, _stored(incoming)).select("seq", "path", "outcome")


_URL = "url || CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '/%2E%2e/x' WHEN 2 THEN '::$DATA' WHEN 3 THEN chr(7) WHEN 4 THEN chr(9) ELSE repeat('/deep', 45) END"


@check("c7_path_issue", f"""
    SELECT page_id, CASE WHEN strlen(p) > 240 THEN 'too_long' WHEN starts_with(p, '//') THEN 'network_path'
      WHEN contains(p, '::$') THEN 'data_stream' WHEN contains(lower(p), '%2e%2e') OR contains(p, '..') THEN 'encoded_traversal'
      WHEN contains(p, chr(7)) THEN 'control_character' END AS issue FROM (SELECT page_id, {_URL} AS p FROM pages)
    UNION ALL SELECT -1 - page_id, CASE WHEN page_id % 2 = 0 THEN 'network_path' END FROM pages
    UNION ALL SELECT -1000000 - page_id, CASE WHEN page_id % 2 = 0 THEN 'system_directory' ELSE 'traversal' END FROM pages""")
def path_issue(spark, d):
    pages = A.table(spark, d, "pages")
    tail = (
        F.when(F.col("page_id") % 6 == 0, F.lit(""))
        .when(F.col("page_id") % 6 == 1, F.lit("/%2E%2e/x"))
        .when(F.col("page_id") % 6 == 2, F.lit("::$DATA"))
        .when(F.col("page_id") % 6 == 3, F.lit("\x07"))
        .when(F.col("page_id") % 6 == 4, F.lit("\t"))
        .otherwise(F.lit("/deep" * 45))
    )
    even = F.col("page_id") % 2 == 0
    host = F.regexp_replace("url", "^https?:", "")
    rows = pages.select("page_id", files.path_issue(F.concat("url", tail)).alias("issue"))
    bare = pages.select((-1 - F.col("page_id")).alias("page_id"), files.path_issue(F.when(even, host).otherwise(F.substr(host, F.lit(3)))).alias("issue"))
    out = F.concat(F.when(even, F.lit("/ETC/")).otherwise(F.lit("/home/x/../")), F.substr(host, F.lit(3)))
    export = pages.select((-1000000 - F.col("page_id")).alias("page_id"), files.export_path_issue(out).alias("issue"))
    return rows.unionByName(bare).unionByName(export)


@check("c8_broken_links", with_views("assets", """
    SELECT id, file_path, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.id) THEN ai_status ELSE 'broken_link' END AS ai_status,
      CAST((SELECT count(*) FROM assets b WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = b.id)) AS BIGINT) AS n_broken FROM assets a"""))
def broken_links(spark, d):
    assets = A.assets(spark, d)
    listing = assets.join(A.table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").select("file_path")
    n = ingest.broken_links(assets, listing).agg(F.count(F.lit(1))).scalar()
    return ingest.mark_broken(assets, listing).select("id", "file_path", "ai_status", n.alias("n_broken"))


@check("c9_mean_threshold_hash", """
    SELECT vec_id AS id, lpad(lower(hex(list_reduce(list_transform(v, lambda x: CAST(CASE WHEN x >= list_sum(v) / len(v) THEN 1 ELSE 0 END AS UBIGINT)),
      lambda acc, b: CAST(acc * 2 + b AS UBIGINT)))), 16, '0') AS phash
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def mean_threshold_hash(spark, d):
    return A.vec_fingerprints(spark, d)


@check("c9_document_fingerprint", with_views("prints64", "SELECT id, lpad(lower(hex(u)), 16, '0') AS phash FROM prints64"))
def document_fingerprint(spark, d):
    return A.assets(spark, d, fingerprint=True, moved=False).select("id", "phash")


@check("c10_hamming_hex", """
    SELECT doc_id, CAST(list_sum(list_transform(range(0, 4), lambda i: bit_count(xor(
      CAST('0x' || substr(h, i * 16 + 1, 16) AS UBIGINT), CAST('0x' || substr(g, i * 16 + 1, 16) AS UBIGINT))))) AS INTEGER) AS distance
    FROM (SELECT doc_id, sha256(text) AS h, sha256(lang) AS g FROM documents)""")
def hamming_hex(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.select("doc_id", hashing.hamming_hex(hashing.content_sha256(F.col("text")), hashing.content_sha256(F.col("lang"))).alias("distance"))


@check("f1_similarity_to_hamming", """
    SELECT DISTINCT l_discount, CAST(round(64 * (1 - (100 - l_discount * 300) / 100.0)) AS INTEGER) AS distance FROM lineitem""")
def similarity_to_hamming(spark, d):
    rows = A.table(spark, d, "lineitem").select("l_discount").distinct()
    return rows.select("l_discount", hashing.similarity_to_hamming(100 - F.col("l_discount") * 300).alias("distance"))


@check("f2_phash_to_long", f"SELECT doc_id, {signed('u')} AS word FROM (SELECT doc_id, CAST('0x' || substr(sha256(text), 1, 16) AS UBIGINT) AS u FROM documents)")
def phash_to_long(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.select("doc_id", hashing.phash_to_long(F.sha2(F.col("text").cast("binary"), 256)).alias("word"))


view("words", "SELECT word, any_value(u) AS u, count(*) AS n, min(id) AS first_id FROM prints GROUP BY word", "prints")
view("near", f"""
    SELECT a.word AS a, b.word AS b, CAST(bit_count(xor(a.u, b.u)) AS INTEGER) AS distance, a.n AS n_a, b.n AS n_b
    FROM words a JOIN words b ON a.word < b.word AND bit_count(xor(a.u, b.u)) <= {RADIUS}
    UNION ALL SELECT word, word, 0, n, n FROM words WHERE n > 1""", "words")
view("id_pairs", f"""
    SELECT x.id AS i, y.id AS j, CAST(bit_count(xor(x.u, y.u)) AS INTEGER) AS distance
    FROM prints x JOIN prints y ON x.id < y.id AND bit_count(xor(x.u, y.u)) <= {RADIUS}""", "prints")
_REACH = """
    reach(id, g) AS (SELECT id, id FROM prints UNION
      SELECT CASE WHEN p.i = r.id THEN p.j ELSE p.i END, r.g FROM reach r JOIN id_pairs p ON p.i = r.id OR p.j = r.id),
    grouped AS MATERIALIZED (SELECT id, min(g) AS group_id FROM reach GROUP BY id),
    sizes AS MATERIALIZED (SELECT group_id, count(*) AS size FROM grouped GROUP BY 1 HAVING count(*) >= 2),
    members AS MATERIALIZED (SELECT g.group_id, g.id, p.u, s.size FROM grouped g JOIN sizes s USING (group_id) JOIN prints p ON p.id = g.id),
    likeness AS MATERIALIZED (SELECT m.group_id, m.size, 1 - avg(p.distance) / 64.0 AS similarity
      FROM id_pairs p JOIN members m ON m.id = p.i GROUP BY 1, 2),
    distances AS MATERIALIZED (SELECT m.group_id, m.id, coalesce((SELECT arg_max(p.distance, p.i) FROM id_pairs p WHERE p.j = m.id), 0) AS distance FROM members m)"""


def grouped_sql(body: str) -> str:
    return with_views("id_pairs, assets, prints", f"WITH {_REACH} {body}", recursive=True)


def _scan(spark, d):
    return D.scan_duplicates(A.assets(spark, d, fingerprint=True), RADIUS)


def _members(spark, d):
    """Group members with the picture columns that retention looks at."""
    assets = A.assets(spark, d).select("id", "file_name", "file_size", "width", "height", "created_at")
    members = shuffled(_scan(spark, d).member_distances().drop("word")).join(assets, "id")
    return Scratch(spark, "members").write(members)[0]


@check("f3_hamming_self_join", with_views("near", "SELECT a, b, distance, n_a, n_b FROM near"))
def hamming_self_join(spark, d):
    return D.hamming_self_join(A.assets(spark, d, fingerprint=True), RADIUS)


@check("f3_hamming_self_join_wide", with_views("words", """
    SELECT a.word AS a, b.word AS b, CAST(bit_count(xor(a.u, b.u)) AS INTEGER) AS distance, a.n AS n_a, b.n AS n_b
    FROM words a JOIN words b ON a.word < b.word AND bit_count(xor(a.u, b.u)) <= 10
    UNION ALL SELECT word, word, 0, n, n FROM words WHERE n > 1"""))
def hamming_self_join_wide(spark, d):
    return D.hamming_self_join(A.assets(spark, d, fingerprint=True), 10)


WITHIN_FIVE = with_views("words, prints, prints64", f"""
    SELECT q.word AS query_word, p.id, CAST(bit_count(xor(q.u, p.u)) AS INTEGER) AS distance
    FROM (SELECT DISTINCT x.u, {signed('x.u')} AS word FROM prints64 x JOIN documents d ON d.doc_id = x.id WHERE d.source IN ('src3', 'src5')) q
    JOIN prints p ON bit_count(xor(q.u, p.u)) <= 5""")


@check("f4_hamming_range_search", WITHIN_FIVE)
def hamming_range_search(spark, d):
    assets = A.assets(spark, d, fingerprint=True)
    asked = assets.filter(F.col("source").isin("src3", "src5")).select(hashing.phash_to_long(F.col("phash")).alias("word"))
    return D.hamming_range_search(asked, assets, 5)


@check("f4_stored_fingerprints", WITHIN_FIVE)
def stored_fingerprints(spark, d):
    """The same from a stored index that was written in two batches."""
    assets = A.assets(spark, d, fingerprint=True)
    path = new_path(spark, "fingerprints")
    prints = D.fingerprints(assets)
    for part in (prints.filter("id % 3 = 0"), prints.filter("id % 3 <> 0")):
        fingerprint_index.append_fingerprints(part, path)
    asked = assets.filter(F.col("source").isin("src3", "src5")).select(hashing.phash_to_long(F.col("phash")).alias("word"))
    return fingerprint_index.search_fingerprints(spark, path, asked, 5)


@check("f5_cluster_pairs", grouped_sql("SELECT group_id, id FROM members"))
def cluster_pairs(spark, d):
    return _scan(spark, d).members().select("group_id", "id")


@check("f6_group_similarity", grouped_sql("SELECT group_id, size, round(similarity, 9) AS similarity FROM likeness"))
def group_similarity(spark, d):
    return _scan(spark, d).ordered_groups().withColumn("similarity", F.round("similarity", 9))


@check("f7_member_distance", grouped_sql("SELECT group_id, id, CAST(distance AS INTEGER) AS distance FROM distances"))
def member_distance(spark, d):
    return _scan(spark, d).member_distances().select("group_id", "id", "distance")


@check("f8_scan_summary", grouped_sql(f"""
    SELECT (SELECT count(*) FROM prints) AS total_scanned, (SELECT CAST(sum(size) AS BIGINT) FROM sizes) AS total_duplicates,
      (SELECT count(*) FROM sizes) AS n_groups, CAST({RADIUS} AS BIGINT) AS threshold"""))
def scan_summary(spark, d):
    return _scan(spark, d).summary()


def _plan_sql(order):
    return f"""SELECT m.group_id, m.id, a.file_size, CASE WHEN row_number() OVER (PARTITION BY m.group_id ORDER BY {order}) = 1 THEN 'keep' ELSE 'delete' END AS action
      FROM members m JOIN distances x ON x.id = m.id JOIN assets a ON a.id = m.id"""


_ORDERS = {
    "highest_resolution": "coalesce(a.width, 0) * coalesce(a.height, 0) DESC, a.file_size, a.id",
    "earliest_import": "a.id",
    "manual": "x.distance, a.file_size DESC, a.id",
    "oldest": "a.created_at, a.id",
    "newest": "a.created_at DESC, a.id",
}


@check("f9_plan_retention", grouped_sql(" UNION ALL ".join(
    f"SELECT '{p}' AS policy, group_id, id, action FROM ({_plan_sql(o)})" for p, o in _ORDERS.items())))
def plan_retention(spark, d):
    members, out = _members(spark, d), None
    for policy in _ORDERS:
        plan = D.plan_retention(members, policy).select(F.lit(policy).alias("policy"), "group_id", "id", "action")
        out = plan if out is None else out.unionByName(plan)
    return out


@check("f10_apply_deletions", with_views("id_pairs, assets, prints, postings, narratives", f"""WITH {_REACH},
    gone AS (SELECT id FROM ({_plan_sql(_ORDERS['highest_resolution'])}) WHERE action = 'delete')
    SELECT 'assets' AS name, count(*) AS n FROM assets WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'postings', count(*) FROM postings WHERE image_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'narratives', count(*) FROM narratives WHERE image_id NOT IN (SELECT id FROM gone)""", recursive=True))
def apply_deletions(spark, d):
    from pictorium.operators.search import build_index

    assets = A.assets(spark, d)
    plan, _ = Scratch(spark, "plan").write(D.plan_retention(_members(spark, d)))
    left = D.apply_deletions(plan, assets=(assets, "id"), postings=(build_index(assets), "image_id"), narratives=(A.narratives(spark, d), "image_id"))
    out = None
    for name, df in left.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@check("f11_deletion_summary", grouped_sql(f"""
    SELECT dry, count(*) FILTER (WHERE action = 'delete') AS deleted, count(*) FILTER (WHERE action = 'keep') AS kept,
      CAST(CASE WHEN dry THEN 0 ELSE sum(file_size) FILTER (WHERE action = 'delete') END AS BIGINT) AS freed,
      CAST(sum(file_size) FILTER (WHERE action = 'delete') AS BIGINT) AS would_free
    FROM ({_plan_sql(_ORDERS['manual'])}), (SELECT unnest([TRUE, FALSE]) AS dry) GROUP BY dry"""))
def deletion_summary(spark, d):
    plan, _ = Scratch(spark, "plan").write(D.plan_retention(_members(spark, d), "manual"))
    dry = D.deletion_summary(plan, True).withColumn("dry", F.lit(True))
    return dry.unionByName(D.deletion_summary(plan).withColumn("dry", F.lit(False)))


@check("f12_recommend_keep", grouped_sql("""
    SELECT group_id, id FROM (SELECT m.group_id, m.id, row_number() OVER (PARTITION BY m.group_id ORDER BY a.width * a.height DESC, a.id) AS rn
      FROM members m JOIN assets a ON a.id = m.id) WHERE rn = 1"""))
def recommend_keep(spark, d):
    return D.recommend_keep(_members(spark, d))


@check("f13_size_groups", with_views("assets", """
    SELECT size, n, id FROM (SELECT file_size AS size, count(*) OVER (PARTITION BY file_size) AS n, id FROM assets) WHERE n > 1
    UNION ALL SELECT -1, count(*), CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM assets GROUP BY file_size HAVING count(*) > 1)"""))
def size_groups(spark, d):
    assets = A.assets(spark, d)
    totals = D.size_group_totals(assets).select(F.lit(-1).cast("long").alias("size"), F.col("n_groups").alias("n"), F.col("n_files").alias("id"))
    return D.size_groups(assets).unionByName(totals)


REPORT = grouped_sql("""
    SELECT x.group_id, x.id, CAST(x.distance AS INTEGER) AS distance, s.size, round(s.similarity, 9) AS similarity
    FROM distances x JOIN likeness s ON s.group_id = x.group_id""")


@check("b7_dedup_report", REPORT)
def dedup_report(spark, d):
    return sinks.dedup_report(_scan(spark, d)).withColumn("similarity", F.round("similarity", 9))


@check("b7_dedup_report_json", REPORT)
def dedup_report_json(spark, d):
    """The report as JSON files, read back."""
    scan, path = _scan(spark, d), new_path(spark, "report")
    sinks.dedup_report_json(scan, path)
    rows = spark.read.schema("group_id long, id long, distance int, size long, similarity double").json(path)
    return rows.withColumn("similarity", F.round("similarity", 9))
