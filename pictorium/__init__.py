"""Pictorium: a PySpark-native analytics engine for large media libraries.

Every operator is a plain function ``DataFrame -> DataFrame`` (chain them with
``df.transform``); every helper in :mod:`pictorium.functions` returns a
``Column``.  Planning, partitioning, spilling and retries are Spark's job.
"""

__version__ = "0.1.0"
