"""Reading, draining and reading back.

Sinks write one folder per micro-batch, ``batch_id=<n>``, in overwrite mode: a
batch that is run again after a failure replaces its own output, so results
are exact however often an executor or the driver is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pictorium.plans.scratch import new_path


def stream_files(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", max_files: int | None = None
) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(folder)


def stream_table(spark: SparkSession, folder: str, name: str, batches: int = 3) -> DataFrame:
    """A whole table as a stream of several micro-batches with its rows in
    mixed order: it is dealt to files by a hash of its first column, ``batches`` of them or as many times that as give a file about the
    size of an input split, and a micro-batch takes its share of the files."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    dealt = new_path(spark, f"stream-{name}")
    share = max(1, math.ceil(rows.rdd.getNumPartitions() / batches))
    rows.repartition(batches * share, F.xxhash64(F.lit(7), rows.columns[0])).write.parquet(dealt)
    return stream_files(spark, dealt, rows.schema, max_files=share)


def stream_assets(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Watch a folder for new files: ``path, modificationTime, length, content``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    from pictorium.sources.tables import keep_supported

    return keep_supported(reader.load(folder))


def batch_folder(out: str, batch_id: int) -> str:
    return f"{out}/batch_id={batch_id}"


def write_batches(out: str, change: Callable[[DataFrame, int], DataFrame] | None = None):
    """A ``foreachBatch`` function that stores each batch under ``out``."""

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = batch if change is None else change(batch, batch_id)
        rows.write.mode("overwrite").parquet(batch_folder(out, batch_id))

    return store


def start(stream: DataFrame, store, mode: str, checkpoint: str) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).foreachBatch(store).start()


def drain(
    stream: DataFrame,
    mode: str = "append",
    change: Callable[[DataFrame, int], DataFrame] | None = None,
    out: str | None = None,
    checkpoint: str | None = None,
) -> str:
    """Run until the source is used up; returns the output folder.  Passing
    the same ``out`` and ``checkpoint`` again continues where it stopped."""
    spark = stream.sparkSession
    out = out or new_path(spark, "stream-out")
    checkpoint = checkpoint or new_path(spark, "stream-state")
    start(stream, write_batches(out, change), mode, checkpoint).awaitTermination()
    return out


def read_batches(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """All stored rows with their ``batch_id``."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(full).option("basePath", out).parquet(out)


def latest_rows(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the row of the newest batch (update-mode output)."""
    values = [c for c in batches.columns if c not in (*keys, "batch_id")]
    newest = batches.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values])
