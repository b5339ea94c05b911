"""Registered queries over the driver tables, each with its plain-SQL twin."""

from __future__ import annotations

from . import catalog, duplicates, graph, grading, logs, metrics, search, sources, streams, vectors  # noqa: F401
from .registry import ENTRIES

__all__ = ["ENTRIES"]
