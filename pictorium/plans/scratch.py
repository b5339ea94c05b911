"""Intermediate tables in the cluster's shared folder.

Iterative operators cut their lineage by writing each round to a table, not by
caching it on executors: a lost executor costs one task, never the round.  A
written table also gives Catalyst true sizes for its join choices.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the context's checkpoint
    folder.  Only a local master gets a folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="pictorium-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/pictorium/{label}-{uuid.uuid4().hex}"


class Scratch:
    """Writes rounds of one operator; superseded rounds can be dropped."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label
        self._paths: dict[int, str] = {}
        self._written: set[str] = set()

    def write(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        """Write ``df`` and read it back; ``metrics`` are aggregates observed
        while writing, so they cost no extra job."""
        path = new_path(self.spark, self.label)
        observed = Observation()
        if metrics:
            df = df.observe(observed, *[c.alias(n) for n, c in metrics.items()])
        df.write.mode("overwrite").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = path
        self._written.add(path)
        return table, (observed.get if metrics else {})

    def close(self) -> None:
        """Delete everything this owner has written and not yet dropped."""
        for path in self._written:
            self._delete(path)
        self._written.clear()
        self._paths.clear()

    def drop(self, table: DataFrame | None) -> None:
        """Delete a table that nothing reads any more."""
        path = self._paths.pop(id(table), None)
        if path is not None:
            self._written.discard(path)
            self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    return Scratch(df.sparkSession, label).write(df)[0]
