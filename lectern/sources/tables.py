"""Table readers. Paging and row caps of a client API have no place here: a read is the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """Any table by path (parquet, json, csv, orc) or, with ``format='jdbc'``, by its options.

    For JDBC pass partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    reader = spark.read.format(format).options(**options)
    return reader.load() if format == "jdbc" else reader.load(path)


def read_chat_messages(messages: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """All messages of a period, oldest first; the bounds reach the scan."""
    if start:
        messages = messages.filter(F.col("created_at") >= F.to_timestamp(F.lit(start)))
    if end:
        messages = messages.filter(F.col("created_at") <= F.to_timestamp(F.lit(end)))
    return messages.orderBy("created_at", "id")


def read_manifest(manifest: DataFrame) -> DataFrame:
    return manifest.select(
        "drive_file_id", "name", "drive_path", "mime_type", "modified_time", "md5_checksum", "chunks_count", "status")


def read_chunks_for_file(chunks: DataFrame, file_id: str) -> DataFrame:
    """Chunk rows of one file; the equality on the metadata field is pushed to the scan."""
    return chunks.filter(F.col("metadata.drive_file_id") == file_id).select("id", "source", "metadata")
