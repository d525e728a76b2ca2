"""Schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


STRING, INT, LONG, DOUBLE, BOOL = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(),
)
TIME = T.TimestampType()

CHUNK_METADATA = _struct(
    ("page_number", INT), ("chunk_index", INT), ("content_hash", STRING), ("drive_file_id", STRING),
    ("drive_modified_time", STRING), ("drive_path", STRING), ("reference_author", STRING),
    ("reference_year", STRING), ("reference_title", STRING), ("reference_section", STRING),
)
CHUNKS = _struct(
    ("id", STRING), ("content", STRING), ("embedding", T.ArrayType(T.FloatType())), ("source", STRING),
    ("metadata", CHUNK_METADATA), ("created_at", TIME), ("content_hash", STRING),
)

RETRIEVAL = T.ArrayType(
    _struct(("document_id", STRING), ("source", STRING), ("rank", INT), ("similarity", DOUBLE))
)
LATENCY = _struct(("embedding", DOUBLE), ("retrieval", DOUBLE), ("generation", DOUBLE), ("total", DOUBLE))
TURN_METADATA = _struct(
    ("request_id", STRING), ("flow_version", STRING), ("prompt_version", STRING), ("mode", STRING),
    ("state_before", STRING), ("state_after", STRING), ("current_topic", STRING), ("quiz_question", INT),
    ("quiz_attempt", INT), ("model_requested", STRING), ("model_used", STRING), ("fallback_used", BOOL),
    ("fallback_reason", STRING), ("embedding_model", STRING), ("has_context", BOOL), ("sources_found", INT),
    ("retrieval", RETRIEVAL), ("latency_ms", LATENCY), ("error_code", STRING),
)
MESSAGES = _struct(
    ("id", STRING), ("session_id", STRING), ("request_id", STRING), ("role", STRING), ("content", STRING),
    ("created_at", TIME), ("metadata", TURN_METADATA),
)
SESSION_STATE = _struct(
    ("session_id", STRING), ("state", STRING), ("mode", STRING), ("current_topic", STRING),
    ("quiz_question", INT), ("quiz_attempt", INT), ("flow_version", STRING), ("revision", LONG),
    ("updated_at", TIME),
)
LISTING = _struct(
    ("id", STRING), ("name", STRING), ("mimeType", STRING), ("modifiedTime", STRING), ("size", LONG),
    ("md5Checksum", STRING), ("drive_path", STRING),
)
MANIFEST = _struct(
    ("drive_file_id", STRING), ("name", STRING), ("drive_path", STRING), ("mime_type", STRING),
    ("modified_time", STRING), ("md5_checksum", STRING), ("chunks_count", INT), ("status", STRING),
    ("last_synced_at", TIME), ("last_error", STRING), ("updated_at", TIME),
)
JOBS = _struct(
    ("id", STRING), ("drive_file_id", STRING), ("action", STRING), ("file_info", STRING), ("status", STRING),
    ("attempts", INT), ("max_attempts", INT), ("lease_expires_at", TIME), ("last_error", STRING),
    ("created_at", TIME), ("updated_at", TIME),
)
EVALUATIONS = _struct(
    ("session_id", STRING), ("request_id", STRING), ("status", STRING), ("attempts", INT),
    ("max_attempts", INT), ("lease_expires_at", TIME), ("score", INT), ("verdict", STRING),
    ("grounding_score", INT), ("completeness_score", INT), ("relevance_score", INT), ("rationale", STRING),
    ("evaluator_model", STRING), ("source_count", INT), ("last_error", STRING), ("updated_at", TIME),
)
FEEDBACK = _struct(("session_id", STRING), ("request_id", STRING), ("rating", STRING), ("created_at", TIME))
HEALTH = _struct(("component", STRING), ("status", STRING), ("detail", STRING), ("checked_at", TIME))
PAGES = T.ArrayType(_struct(("page_number", INT), ("text", STRING)))
ACCEPTANCE_CASES = _struct(
    ("id", STRING), ("description", STRING), ("messages", T.ArrayType(STRING)),
    ("expect", _struct(
        ("includes", T.ArrayType(STRING)), ("excludes", T.ArrayType(STRING)),
        ("sourcesMin", INT), ("maxLatencyMs", INT),
    )),
)
