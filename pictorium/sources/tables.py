"""Readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pictorium import schemas
from pictorium.functions import fixed_values as V
from pictorium.functions.files import extension


def scan_assets(spark: SparkSession, paths: str | list[str], recursive: bool = True, content: bool = True) -> DataFrame:
    """Picture files below ``paths`` as ``path, modificationTime, length[,
    content]``.  Without ``content`` only the listing is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("ignoreMissingFiles", "true")
        .load(paths)
    )
    kept = keep_supported(files)
    return kept if content else kept.drop("content")


def keep_supported(listing: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose file extension, in any case, is one we import."""
    return listing.filter(extension(F.col(path)).isin(V.EXTENSIONS))


def read_catalog(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Full scan of a catalog table with its declared schema."""
    return spark.read.schema(schemas.TABLES[table]).parquet(f"{root.rstrip('/')}/{table}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines; text files carry no line number, see :func:`number_lines`."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(seq, line)`` in file order: partitions of an unsplit text scan are
    numbered by file and block, so their order is the line order."""
    from pyspark.sql import Window

    from pictorium.plans.scratch import materialize

    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    lines = materialize(lines, "lines")
    blocks = lines.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1))
    # one row per file block
    offsets = blocks.select("_file", "_start", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_at"))
    joined = lines.withColumn("_row", inside).join(offsets, ["_file", "_start"])
    return joined.select((F.col("_before") + F.col("_row")).cast("long").alias("seq"), "line")


_PROPERTIES = T.MapType(T.StringType(), T.StringType())


def load_graph(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Stored nodes, edges, communities and the adjacency in both directions;
    properties that are no JSON object become an empty map."""
    root = root.rstrip("/")

    def table(name):
        return spark.read.parquet(f"{root}/{name}")

    def decoded(df):
        parsed = F.from_json("properties", _PROPERTIES)
        empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        return df.withColumn("properties", F.coalesce(parsed, empty))

    nodes, edges = decoded(table("kg_nodes")), decoded(table("kg_edges"))
    from pictorium.operators.graph import both_ways

    return {"nodes": nodes, "edges": edges, "communities": table("kg_communities"), "adjacency": both_ways(edges)}
