"""Explicit table schemas of the catalog (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

_ENTITY = T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])
_TAGS = T.ArrayType(T.StringType())
_VECTOR = T.ArrayType(T.FloatType())


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


L, S, I, D, B, TS = (
    T.LongType(),
    T.StringType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampNTZType(),
)

IMAGES = _table(
    ("id", L), ("file_path", S), ("file_name", S), ("file_size", L), ("file_hash", S),
    ("mime_type", S), ("width", I), ("height", I), ("thumbnail_path", S), ("phash", S),
    ("exif_data", S), ("ai_status", S), ("ai_tags", _TAGS), ("ai_description", S),
    ("ai_category", S), ("ai_confidence", D), ("ai_model", S), ("ai_processed_at", TS),
    ("ai_error_message", S), ("ai_retry_count", I), ("source", S), ("created_at", TS),
    ("updated_at", TS), ("generation_source", S), ("generation_metadata", S),
    ("generation_workflow_id", S), ("ai_provider", S), ("ai_tag_status", S),
)
POSTINGS = _table(("image_id", L), ("term", S), ("field", S), ("weight", D))
NARRATIVES = _table(
    ("id", L), ("image_id", L), ("content", S), ("entities", T.ArrayType(_ENTITY)),
    ("embedding", _VECTOR), ("created_at", TS), ("updated_at", TS),
)
CALIBRATION_SAMPLES = _table(
    ("id", L), ("image_id", L), ("predicted_category", S), ("raw_confidence", D),
    ("is_correct", B), ("annotated_at", TS),
)
CALIBRATION_REPORTS = _table(
    ("id", L), ("report", S), ("total_samples", L), ("overall_ece", D), ("computed_at", S), ("created_at", TS),
)
CALIBRATION_CURVES = _table(
    ("id", L), ("category", S), ("curve", S), ("total_samples", L), ("computed_at", S),
)
TAG_CORRECTIONS = _table(
    ("id", L), ("image_id", L), ("old_tags", _TAGS), ("new_tags", _TAGS), ("corrected_at", TS),
)
ERROR_PATTERNS = _table(
    ("pattern_name", S), ("pattern_description", S), ("occurrence_count", L), ("first_seen", TS), ("last_seen", TS),
)
GRAPH_NODES = _table(
    ("id", S), ("node_type", S), ("label", S), ("properties", S), ("embedding", _VECTOR),
    ("community_id", L), ("degree", L),
)
GRAPH_EDGES = _table(
    ("id", S), ("source_id", S), ("target_id", S), ("edge_type", S), ("weight", D), ("properties", S),
)
GRAPH_COMMUNITIES = _table(
    ("id", L), ("size", L), ("central_node_id", S), ("tags", _TAGS), ("density", D),
)
SETTINGS_TABLE = _table(("key", S), ("value", S), ("updated_at", TS))
TASK_QUEUE = _table(
    ("id", L), ("image_id", L), ("task_type", S), ("status", S), ("priority", I), ("retry_count", I),
    ("max_retries", I), ("error_message", S), ("created_at", TS), ("started_at", TS), ("completed_at", TS),
)
VECTORS = _table(("id", S), ("embedding", _VECTOR), ("metadata", S), ("image_path", S), ("created_at", TS))
FILE_EVENTS = _table(("event_type", S), ("file_path", S), ("timestamp", L))

TABLES = {
    "images": IMAGES,
    "search_index": POSTINGS,
    "narratives": NARRATIVES,
    "calibration_samples": CALIBRATION_SAMPLES,
    "calibration_reports": CALIBRATION_REPORTS,
    "calibration_curves": CALIBRATION_CURVES,
    "tag_corrections": TAG_CORRECTIONS,
    "error_patterns": ERROR_PATTERNS,
    "kg_nodes": GRAPH_NODES,
    "kg_edges": GRAPH_EDGES,
    "kg_communities": GRAPH_COMMUNITIES,
    "settings": SETTINGS_TABLE,
    "task_queue": TASK_QUEUE,
    "vectors": VECTORS,
    "file_events": FILE_EVENTS,
}
