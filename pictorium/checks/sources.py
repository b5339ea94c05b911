"""Readers and writers: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from pictorium.functions.text import csv_escape
from pictorium.plans.scratch import new_path
from pictorium.sources import adapters as A
from pictorium.sources import sinks, tables

from .catalog import shown
from .graph import _graph
from .metrics import reports
from .registry import check, stamp, with_views


@check("a1_keep_supported", with_views("incoming", "SELECT seq, path FROM incoming WHERE ext IN ('jpg', 'png', 'gif')"))
def keep_supported(spark, d):
    return tables.keep_supported(A.incoming_files(spark, d)).select("seq", "path")


@check("a3_read_log", with_views("log_lines", "SELECT seq, line FROM log_lines"))
def read_log(spark, d):
    path = new_path(spark, "log")
    A.log_lines(spark, d).orderBy("seq").select("line").write.text(path)
    return tables.number_lines(spark, path)


@check("a5_load_graph", with_views("nodes, edges, links", """
    SELECT 'nodes' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges
    UNION ALL SELECT 'adjacency', count(*) FROM links UNION ALL SELECT 'labelled', count(*) FROM nodes WHERE category IS NOT NULL
    UNION ALL SELECT 'communities', 1"""))
def load_graph(spark, d):
    root = new_path(spark, "graph")
    sinks.save_graph(_graph(spark, d), root)
    loaded = tables.load_graph(spark, root)
    loaded["labelled"] = loaded["nodes"].filter(F.try_element_at("properties", F.lit("category")).isNotNull())
    out = None
    for name, df in loaded.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


_FULL = f"""file_name, file_path, file_size, width, height, file_hash, {{}} category, {{}} tags, {{}} digest, {{}} ai_confidence,
    CAST(NULL AS VARCHAR) AS ai_model, {stamp("created_at")} AS imported_at, {{}} ai_processed_at, CAST(NULL AS VARCHAR) AS exif_data, CAST(NULL AS VARCHAR) AS thumbnail_path"""
_WITH_AI = _FULL.format("ai_category AS", "array_to_string(ai_tags, '|') AS", "md5(ai_description) AS", "ai_confidence AS", stamp("ai_processed_at") + " AS")
_EXPORT = f"""SELECT id, {_WITH_AI}, (SELECT count(*) FROM assets WHERE id IN (SELECT doc_id FROM labels)) AS exported FROM assets WHERE id IN (SELECT doc_id FROM labels)
    UNION ALL SELECT -1 - id, {_FULL.format(*["NULL AS"] * 5)}, (SELECT count(*) FROM assets) FROM assets"""


def _shown_export(df, tags):
    return df.select(
        "id", "file_name", "file_path", "file_size", "width", "height", "file_hash", "category", tags.alias("tags"), F.md5(F.col("ai_description").cast("binary")).alias("digest"),
        "ai_confidence", "ai_model", shown("imported_at"), shown("ai_processed_at"), "exif_data", "thumbnail_path",
    )


@check("b1_export_json", with_views("assets", _EXPORT))
def export_json(spark, d):
    assets = A.assets(spark, d)
    ids = A.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    full, slim = new_path(spark, "json"), new_path(spark, "json")
    schema = sinks.export_frame(assets).schema
    tags = F.array_join("ai_tags", "|")
    one, two = sinks.export_json(assets, full, ids), sinks.export_json(assets, slim, include_metadata=False)
    n = [x.filter("file_bytes > 0").select("exported_count").scalar() for x in (one, two)]
    one = _shown_export(spark.read.schema(schema).json(full), tags).withColumn("exported", n[0])
    two = _shown_export(spark.read.schema(schema).json(slim), tags).withColumn("id", -1 - F.col("id")).withColumn("exported", n[1])
    return one.unionByName(two)


@check("b2_export_csv", with_views("assets", f"SELECT id, {_WITH_AI} FROM assets"))
def export_csv(spark, d):
    path = new_path(spark, "csv")
    sinks.export_csv(A.assets(spark, d), path)
    schema = ", ".join(f"{f.name} {'string' if f.name == 'ai_tags' else f.dataType.simpleString()}" for f in sinks.export_frame(A.assets(spark, d)).schema)
    back = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    tags = F.array_join(F.from_json("ai_tags", "array<string>"), "|")
    return _shown_export(back, tags)


@check("b2_export_csv_short", with_views("assets", "SELECT id, file_path, file_name, file_size, (SELECT count(*) FROM assets) AS exported FROM assets"))
def export_csv_short(spark, d):
    path = new_path(spark, "csv")
    n = sinks.export_csv_short(A.assets(spark, d), path).filter("file_bytes > 0").select("exported_count").scalar()
    back = spark.read.option("header", True).schema("id long, file_path string, file_name string, file_size long").csv(path)
    return back.withColumn("exported", n)


@check("b2_csv_escape", with_views("assets", """
    SELECT doc_id, CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN md5('"' || replace(text, '"', '""') || '"') ELSE md5(text) END AS digest,
      (SELECT id || ',' || file_path || ',' || file_name || ',' || file_size FROM assets WHERE id = doc_id) AS line FROM documents"""))
def escape_csv(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", F.md5(csv_escape(F.col("text")).cast("binary")).alias("digest"))
    return docs.join(sinks.csv_lines(A.assets(spark, d)).withColumnRenamed("id", "doc_id"), "doc_id")


@check("b3_export_xml", with_views("assets", "SELECT id, file_path, file_name, file_size FROM assets"))
def export_xml(spark, d):
    path = new_path(spark, "xml")
    sinks.export_xml(A.assets(spark, d), path)
    return spark.read.format("xml").schema("id long, file_path string, file_name string, file_size long").option("rowTag", "record").load(path)


@check("b4_save_graph", with_views("nodes, edges", "SELECT (SELECT count(*) FROM nodes) + (SELECT count(*) FROM edges) + 1 AS n_rows"))
def save_graph(spark, d):
    return sinks.save_graph(_graph(spark, d), new_path(spark, "graph"))


CALIBRATION = with_views("reports", """
    SELECT 'report' AS part, CAST(id AS VARCHAR) AS key, total_samples FROM reports UNION ALL SELECT 'report', '99', 0
    UNION ALL SELECT 'curve', predicted_category, CASE WHEN predicted_category = 'en' THEN 0 ELSE total_samples END FROM reports""")


@check("b5_save_calibration", CALIBRATION)
def save_calibration(spark, d):
    made = reports(spark, d)
    old = made.select("id", "total_samples")
    new = old.limit(1).select(F.lit(99).cast("long").alias("id"), F.lit(0).cast("long").alias("total_samples"))
    curves = made.select(F.col("predicted_category").alias("category"), "total_samples", F.lit("2024-01-01").alias("computed_at"))
    curve = curves.filter("category = 'en'").select("category", F.lit(0).cast("long").alias("total_samples"), F.lit("2024-06-01").alias("computed_at"))
    return _calibration(*sinks.save_calibration(old, new, curves, curve))


@check("b5_store_calibration", CALIBRATION)
def store_calibration(spark, d):
    """The same written and read back."""
    made, root = reports(spark, d), new_path(spark, "calibration")
    old = made.select("id", "total_samples")
    new = old.limit(1).select(F.lit(99).cast("long").alias("id"), F.lit(0).cast("long").alias("total_samples"))
    curves = made.select(F.col("predicted_category").alias("category"), "total_samples", F.lit("2024-01-01").alias("computed_at"))
    sinks.store_calibration(root, old, curves)
    sinks.store_calibration(root, new, curves.filter("category = 'en'").select("category", F.lit(0).cast("long").alias("total_samples"), F.lit("2024-06-01").alias("computed_at")))
    return _calibration(*sinks.stored_calibration(spark, root))


def _calibration(all_reports, all_curves):
    one = all_reports.select(F.lit("report").alias("part"), F.col("id").cast("string").alias("key"), "total_samples")
    return one.unionByName(all_curves.select(F.lit("curve").alias("part"), F.col("category").alias("key"), "total_samples"))


@check("b6_export_log", with_views("log_lines", "SELECT count(*) AS n_lines FROM log_lines WHERE contains(line, 'ERROR')"))
def export_log(spark, d):
    return sinks.export_log(A.log_lines(spark, d), new_path(spark, "log"), "error")


@check("b8_export_manifest", """
    SELECT doc_id AS seq, doc_id AS id, CASE WHEN n = 1 THEN source || '.' || lang ELSE source || '_' || (n - 1) || '.' || lang END AS target, CAST(NULL AS VARCHAR) AS error
    FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)
    UNION ALL SELECT 1000000000 + doc_id, -1 - doc_id, NULL, 'not found' FROM labels""")
def export_manifest(spark, d):
    docs = A.table(spark, d, "documents")
    path = F.concat(F.lit("/lib/"), F.col("doc_id").cast("string"), F.lit("/"), "source", F.lit("."), "lang")
    assets = docs.select(F.col("doc_id").alias("id"), path.alias("file_path"))
    asked = docs.select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"))
    missing = A.table(spark, d, "labels").select((F.lit(1000000000) + F.col("doc_id")).alias("seq"), (-1 - F.col("doc_id")).alias("id"))
    return sinks.export_manifest(assets, asked.unionByName(missing))
