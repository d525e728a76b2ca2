"""Session and turn queries over message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import is_uuid
from .ordering import BUCKET_ROWS, first_n_per_key, previous_value

def recent_history(messages: DataFrame, n: int = 20) -> DataFrame:
    """The newest n rows of each session, then only user and assistant ones; ``position`` counts back from 1."""
    newest = first_n_per_key(messages, ["session_id"], [F.desc("created_at"), F.desc("id")], n, "position")
    return newest.filter(F.col("role").isin("user", "assistant") & F.col("content").isNotNull())


def session_history(messages: DataFrame, limit: int = 50) -> DataFrame:
    """The oldest rows of each session, oldest first."""
    return first_n_per_key(messages, ["session_id"], [F.asc("created_at"), F.asc("id")], limit, "position")


def find_completed_turns(requests: DataFrame, messages: DataFrame) -> DataFrame:
    """Stored answers of requests that were already served (a repeated request replays them)."""
    answers = messages.filter(F.col("role") == "assistant").select("session_id", "request_id", "content", "metadata")
    return answers.join(requests.select("session_id", "request_id"), ["session_id", "request_id"], "left_semi")


def _role_count(role: str) -> Column:
    return F.count_if(F.col("role") == role)


def session_summary(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Message counts per known session; sessions without messages count 0.

    Messages are aggregated before the join, so the join moves one row per session."""
    counted = messages.groupBy("session_id").agg(
        F.count("*").alias("total_messages"), _role_count("user").alias("user_messages"),
        _role_count("assistant").alias("ai_messages"), F.max("created_at").alias("last_message_at"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sessions.join(counted, sessions["id"] == counted["session_id"], "left").select(
        sessions["id"].alias("session_id"), sessions["created_at"].alias("session_started_at"),
        sessions["updated_at"].alias("session_last_activity"), zero("total_messages"), zero("user_messages"),
        zero("ai_messages"), "last_message_at")


def orphan_sessions(messages: DataFrame, sessions: DataFrame, limit: int = 50) -> DataFrame:
    """Sessions that occur in messages only, the most recent first."""
    per_session = messages.groupBy("session_id").agg(
        F.count("*").alias("message_count"), F.min("created_at").alias("first_message_at"),
        F.max("created_at").alias("last_message_at"))
    known = sessions.select(F.col("id").alias("session_id"))
    return per_session.join(known, "session_id", "left_anti").orderBy(
        F.desc("last_message_at"), "session_id").limit(limit)


def message_audit(messages: DataFrame) -> DataFrame:
    """One row of totals. An assistant row is instrumented when its metadata is there and not empty."""
    spoken = F.col("role") == "assistant"
    return messages.agg(
        F.count("*").alias("total_messages"),
        F.count_distinct("session_id").alias("total_sessions"),
        F.count_if(spoken).alias("assistant_messages"),
        F.count_if(spoken & F.col("metadata").isNotNull()).alias("assistant_messages_with_metadata"),
        F.min("created_at").alias("first_message_at"),
        F.max("created_at").alias("last_message_at"),
    )


def chunk_audit(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("total_chunks"),
        F.count_distinct("source").alias("total_sources"),
        F.count("drive_file_id").alias("chunks_with_drive_file_id"),
        F.count_distinct("drive_file_id").alias("distinct_drive_file_ids"),
        F.count("content_hash").alias("chunks_with_content_hash"),
    )


def pair_turns(messages: DataFrame) -> DataFrame:
    """User and assistant row of each request side by side; ``error`` names the side that is missing."""
    side = lambda role, field: F.max(F.when(F.col("role") == role, F.col(field)))
    paired = messages.filter(F.col("request_id").isNotNull() & F.col("role").isin("user", "assistant")).groupBy(
        "session_id", "request_id").agg(
        side("user", "content").alias("question"), side("assistant", "content").alias("answer"),
        F.max("created_at").alias("created_at"))
    return paired.withColumn(
        "error", F.when(F.col("answer").isNull(), F.lit("ASSISTANT_TURN_NOT_FOUND"))
        .when(F.col("question").isNull(), F.lit("USER_TURN_NOT_FOUND")))


# Role names of the older message table.
LEGACY_ROLES = {"user": "human", "assistant": "ai"}


def role_map(role: Column, to_legacy: bool = True) -> Column:
    """Translate roles between the two naming schemes; other values stay."""
    pairs = LEGACY_ROLES if to_legacy else {v: k for k, v in LEGACY_ROLES.items()}
    out = None
    for old, new in pairs.items():
        out = F.when(role == old, F.lit(new)) if out is None else out.when(role == old, F.lit(new))
    return out.otherwise(role)


def session_id_kinds(messages: DataFrame) -> DataFrame:
    """How many sessions and messages have a UUID id and how many an older one."""
    return messages.groupBy("session_id").agg(F.count("*").alias("n")).groupBy(
        F.when(is_uuid("session_id"), F.lit("uuid")).otherwise(F.lit("legacy")).alias("kind")
    ).agg(F.count("*").alias("sessions"), F.sum("n").alias("messages"))


def invalid_transitions(turns: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Turns whose state before differs from the state the session was left in.

    turns: id, session_id, created_at, state_before, state_after. Sessions of more than ``bucket_rows`` turns are
    looked through in several tasks."""
    looked = previous_value(turns, ["session_id"], ["created_at", "id"], "state_after", "previous_state", bucket_rows)
    return looked.filter(F.col("previous_state").isNotNull() & (F.col("state_before") != F.col("previous_state")))
