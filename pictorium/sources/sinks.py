"""Writers and export shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pictorium import schemas
from pictorium.functions.text import base_name, csv_escape
from pictorium.operators.common import only_ids, upsert_latest
from pictorium.operators.dedup import DuplicateScan
from pictorium.operators.graph import Graph
from pictorium.operators.logs import filter_log
from pictorium.plans.ordering import SPAN, number_within, running_max
from pictorium.plans.scratch import Scratch
from pictorium.plans.skew import shuffled
from pictorium.sources.tables import read_log

# fixed values: columns of the full export and of the short CSV, in order
EXPORT_COLUMNS = [
    "id", "file_name", "file_path", "file_size", "width", "height", "file_hash", "category", "ai_description", "ai_tags",
    "ai_confidence", "ai_model", "imported_at", "ai_processed_at", "exif_data", "thumbnail_path",
]
SHORT_COLUMNS = ["id", "file_path", "file_name", "file_size"]
AI_COLUMNS = ["category", "ai_description", "ai_tags", "ai_confidence", "ai_model", "ai_processed_at"]
#: Exported under another name than they are stored.
STORED_AS = {"category": "ai_category", "imported_at": "created_at"}


def export_frame(assets: DataFrame, ids=None, include_metadata: bool = True) -> DataFrame:
    """Rows to export, ordered by id; without metadata the AI fields are NULL.
    Rows with missing AI fields stay; columns the table does not have are NULL."""
    chosen = assets if ids is None else only_ids(assets, ids)

    def column(name: str) -> Column:
        stored = STORED_AS.get(name, name)
        if stored in assets.columns and (include_metadata or name not in AI_COLUMNS):
            return F.col(stored).alias(name)
        return F.lit(None).cast(schemas.IMAGES[stored].dataType).alias(name)

    return chosen.select(*[column(c) for c in EXPORT_COLUMNS]).orderBy("id")


def _written(frame: DataFrame, path: str, kind: str, **options) -> DataFrame:
    """Writes a frame; one row with the number of records and the bytes of the files."""
    seen = Observation()
    frame.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").options(**options).format(kind).save(path)
    files = frame.sparkSession.read.format("binaryFile").load(path)
    return files.agg(F.lit(seen.get["n"]).cast("long").alias("exported_count"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("file_bytes"))


def export_json(assets: DataFrame, path: str, ids=None, include_metadata: bool = True) -> DataFrame:
    """Full columns; returns the number of records and bytes written."""
    return _written(export_frame(assets, ids, include_metadata), path, "json", ignoreNullFields="false")


def export_csv(assets: DataFrame, path: str, ids=None) -> DataFrame:
    """Header plus the full columns, tags as JSON text; returns the number of records and bytes written."""
    frame = export_frame(assets, ids).withColumn("ai_tags", F.to_json("ai_tags"))
    return _written(frame, path, "csv", header="true", quote='"', escape='"')


def export_csv_short(assets: DataFrame, path: str, ids=None) -> DataFrame:
    """Header plus the four columns of the short form."""
    chosen = assets if ids is None else only_ids(assets, ids)
    return _written(chosen.select(*SHORT_COLUMNS).orderBy("id"), path, "csv", header="true", quote='"', escape='"')


def csv_lines(assets: DataFrame, ids=None) -> DataFrame:
    """The short four-column CSV form as text lines."""
    chosen = assets if ids is None else only_ids(assets, ids)
    line = F.concat_ws(
        ",", F.col("id").cast("string"), csv_escape(F.col("file_path")), csv_escape(F.col("file_name")), F.col("file_size").cast("string")
    )
    return chosen.select("id", line.alias("line")).orderBy("id")


def export_xml(assets: DataFrame, path: str, ids=None) -> DataFrame:
    chosen = assets if ids is None else only_ids(assets, ids)
    return _written(chosen.select(*SHORT_COLUMNS).orderBy("id"), path, "xml", rootTag="records", rowTag="record")


def save_graph(graph: Graph, root: str) -> DataFrame:
    """Overwrites the graph tables and returns their row total."""
    root = root.rstrip("/")
    graph.node_table().write.mode("overwrite").parquet(f"{root}/kg_nodes")
    graph.edge_table().write.mode("overwrite").parquet(f"{root}/kg_edges")
    graph.community_table().write.mode("overwrite").parquet(f"{root}/kg_communities")
    graph.community_tag_table().write.mode("overwrite").parquet(f"{root}/kg_community_tags")
    spark = graph.nodes.sparkSession
    counted = [spark.read.parquet(f"{root}/{t}").select(F.lit(t).alias("name")) for t in ("kg_nodes", "kg_edges", "kg_communities")]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).agg(F.count(F.lit(1)).alias("n_rows"))


def clear_graph(graph: Graph, root: str) -> DataFrame:
    empty = Graph(graph.nodes.limit(0), graph.edges.limit(0), graph.parts.limit(0))
    return save_graph(empty, root)


def save_calibration(reports: DataFrame, new_report: DataFrame, curves: DataFrame, new_curve: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report appended, curve replaced by category."""
    return reports.unionByName(new_report), upsert_latest(curves, new_curve, ["category"], "computed_at")


def store_calibration(root: str, new_report: DataFrame, new_curve: DataFrame) -> None:
    """Writes a calibration below ``root``: the report is appended, the curve replaces those of its categories, whose folders alone
    are written."""
    root = root.rstrip("/")
    new_report.write.mode("append").parquet(f"{root}/reports")
    replace = new_curve.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    replace.partitionBy("category").parquet(f"{root}/curves")


def stored_calibration(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Reports and curves as stored.  A category is text whatever it looks like."""
    curves = spark.read.option("basePath", f"{root}/curves")
    kinds = T.StructType([f if f.name != "category" else T.StructField("category", T.StringType()) for f in curves.parquet(f"{root}/curves").schema])
    return spark.read.parquet(f"{root}/reports"), curves.schema(kinds).parquet(f"{root}/curves")


def export_log(lines: DataFrame, path: str, level: str | None = None) -> DataFrame:
    """Matching lines as text; returns their count."""
    filter_log(lines, level).select("line").write.mode("overwrite").text(path)
    return read_log(lines.sparkSession, path).agg(F.count(F.lit(1)).alias("n_lines"))


def dedup_report(scan: DuplicateScan) -> DataFrame:
    """One row per member with its group's size and similarity.  Flat, so a
    group of any size is written by many tasks."""
    groups, _ = scan.scratch.write(scan.groups())
    return scan.member_distances().select("group_id", "id", "distance").join(shuffled(groups), "group_id")


def dedup_report_json(scan: DuplicateScan, path: str) -> None:
    dedup_report(scan).write.mode("overwrite").json(path)


def _with_suffix(name: Column, number: Column) -> Column:
    stem = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1)
    ext = F.regexp_extract(name, r"^.+?(\.[^.]+)?\.?$", 1)
    return F.when(number == 0, name).otherwise(F.concat(stem, F.lit("_"), number.cast("string"), ext))


def export_manifest(assets: DataFrame, requested: DataFrame, span: int = SPAN) -> DataFrame:
    """``requested(seq, id)`` to ``(seq, id, target, error)``: in request
    order each row takes its name, or the first free of ``name_1``, ``name_2``,
    …; unknown ids become errors.

    Rows of one name start with consecutive numbers, which is the least each
    can get.  Only a file that is really called ``name_3`` can then collide; of
    the two the later request moves on, and its followers with it.  That is
    deferred acceptance with the request order as everyone's preference, so it
    ends in the outcome of serving the requests one by one.  Numbering runs per
    chunk of the request order, so a name asked for by a third of all requests
    is not sorted in one task.
    """
    scratch = Scratch(assets.sparkSession, "manifest")
    known = assets.select("id", base_name(F.col("file_path")).alias("name"))
    joined, _ = scratch.write(requested.join(known, "id", "left").select("seq", "id", "name"))
    numbered = number_within(joined.filter(F.col("name").isNotNull()), ["name"], "seq", "nth", span)
    state = numbered.withColumn("number", F.col("nth") - 1)
    while True:
        state, _ = scratch.write(state.withColumn("target", _with_suffix(F.col("name"), F.col("number"))))
        claims = state.groupBy("target").agg(F.min("seq").alias("winner"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        lost, seen = scratch.write(state.join(claims, "target").filter(F.col("seq") > F.col("winner")).select("seq", "name"), n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        names, _ = scratch.write(lost.select("name").distinct())
        moving = state.join(names, "name", "left_semi").join(lost.select("seq", F.lit(1).alias("lost")), "seq", "left")
        slack = F.col("number") + F.coalesce("lost", F.lit(0)) - F.col("nth")
        moved = running_max(moving, ["name"], "seq", slack, "slack", span).withColumn("number", F.col("slack") + F.col("nth"))
        columns = ["seq", "id", "name", "nth", "number"]
        state = state.join(names, "name", "left_anti").select(*columns).unionByName(moved.select(*columns))
    none = F.lit(None).cast("string")
    missing = joined.filter(F.col("name").isNull()).select("seq", "id", none.alias("target"), F.lit("not found").alias("error"))
    return state.select("seq", "id", "target", none.alias("error")).unionByName(missing)
