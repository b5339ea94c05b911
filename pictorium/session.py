"""Session settings the library is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # bounds driver-side plan strings for the wide generated expressions
    "spark.sql.debug.maxToStringFields": "100",
}


def build_session(app: str = "pictorium", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` (dots as ``__``) overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def local_session(cores: int | str = 8, memory: str = "12g", **extra: str) -> SparkSession:
    """Single-JVM session for tests and the bench."""
    return build_session(
        "pictorium-local",
        master=f"local[{cores}]",
        **{
            "spark__driver__memory": memory,
            "spark__sql__shuffle__partitions": str(cores),
            "spark__ui__enabled": "false",
            "spark__ui__showConsoleProgress": "false",
            **extra,
        },
    )
