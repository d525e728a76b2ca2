"""Hash and turn deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.identity import content_hash
from .ordering import oldest_per_key

TURN_KEY = ["session_id", "request_id", "role"]


def backfill_content_hash(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("content_hash", F.coalesce("content_hash", content_hash("content")))


def skip_existing_by_hash(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New chunks whose hash the target lacks; repeats within ``new`` stay."""
    return new.join(existing.select("content_hash"), "content_hash", "left_anti")


def hash_duplicates(chunks: DataFrame) -> DataFrame:
    """Hashes that occur more than once, nulls aside."""
    return (
        chunks.filter(F.col("content_hash").isNotNull())
        .groupBy("content_hash").agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)
    )


def dedup_turns(messages: DataFrame) -> DataFrame:
    """The first write of each (session, request, role) wins; rows without a request id are never duplicates."""
    keyed = F.col("request_id").isNotNull()
    first = oldest_per_key(messages.filter(keyed), TURN_KEY, [F.col("created_at"), F.col("id")])
    return first.unionByName(messages.filter(~keyed))


def distinct_sources(messages: DataFrame) -> DataFrame:
    """Source names of each turn, first occurrence first."""
    sources = F.array_distinct(F.transform("metadata.retrieval", lambda x: x["source"]))
    return messages.withColumn("sources", sources)
