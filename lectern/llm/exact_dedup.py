"""Exact duplicates against a persistent digest index.

The index is a table with one row per distinct text, bucketed and sorted by the digest of the normalised text. A new batch is
reduced to its distinct digests, those already indexed fall out by a sort-merge anti-join in which the index is not moved, and
the rest is appended. Adding a batch again changes nothing, so a lost run is repeated as it is. Native throughout; texts are read once and never moved.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import prepare, scratch_path
from .common import packed, restricted, stored

#: Digests of a bucket that the number of buckets aims at.
BUCKET_ROWS = 2_000_000
#: Groups of more than this share of all rows are joined on their own; there are at most as many of them as its inverse.
LARGE = 1e-4


def normalised(text: Column) -> Column:
    """A text with every run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest``: SHA-256 of the normalised whole text, as 32 bytes."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))


class DigestIndex:
    """A table ``digest, keep_id`` in ``path``, under ``name`` in the session's catalog, in ``buckets`` buckets by digest.

    An index written by another session is opened by the same name, path and number of buckets."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int):
        self.spark, self.name, self.path, self.buckets = prepare(spark), name, path, buckets
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def missing(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups`` (one per digest) whose digest is not in the index."""
        return groups.join(self.read().hint("merge"), "digest", "left_anti")

    def add(self, digests: DataFrame) -> None:
        """Append the new digests of a batch (``doc_id, digest``), each with the smallest id that has it in the batch."""
        fresh = self.missing(digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id")))
        # one file per bucket and batch
        fresh.select("digest", "keep_id").repartition(self.buckets, "digest").write.insertInto(self.name)

    def compact(self, path: str) -> "DigestIndex":
        """A copy with one sorted file per bucket, after many batches."""
        copy = DigestIndex(self.spark, f"{self.name}_{uuid.uuid4().hex[:8]}", path, self.buckets)
        self.read().repartition(self.buckets, "digest").write.insertInto(copy.name)
        return copy

    def drop(self) -> None:
        """Forget the name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def open_index(spark: SparkSession, rows: int) -> DigestIndex:
    """A new index in the shared folder, with buckets for about ``rows`` distinct texts."""
    return DigestIndex(spark, f"digests_{uuid.uuid4().hex}", scratch_path(spark, "digest-index"), max(8, -(-rows // BUCKET_ROWS)))


def memberships(digests: DataFrame, index: DigestIndex) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for stored rows (doc_id, digest), all of which are indexed.

    ``group_size`` counts the given rows. Groups with a large share of all rows are few and go to the rows; the others
    are merged with them by digest."""
    groups = stored(digests.groupBy("digest").agg(F.count("*").alias("group_size")).join(
        index.read().hint("merge"), "digest"), "groups")
    least = max(1000, int(LARGE * digests.count()))
    large = groups.filter(F.col("group_size") >= least)
    rest = digests.join(F.broadcast(large), "digest", "left_anti").join(
        groups.filter(F.col("group_size") < least).hint("merge"), "digest")
    both = rest.unionByName(digests.join(F.broadcast(large), "digest"))
    return both.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact duplicates of a table: ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row.

    Texts are equal if they are identical after every run of ASCII white space became one space; a null text is an empty one,
    and a leading or trailing run counts as one space. Of equal texts the smallest id stays. Without an ``index`` a new one is made,
    and the documents are loaded in two batches, the smaller half of the ids first, so that a text keeps the
    smallest of all ids. With a given index, texts that it holds keep the id they were indexed with; ``group_size`` counts the
    rows of ``docs``.

    Null ids come last: they stay only where a text has no other id. Rows of equal id and text are all marked as kept
    (``unique_documents`` takes one). Extra columns are not read; an empty table gives an empty result.
    """
    digests = stored(digested(docs, id_col, text_col), "digests")
    if index is not None:
        index.add(digests)
        return memberships(digests, index)
    rows, middle = digests.agg(F.count("*"), F.percentile_approx("doc_id", 0.5, 1000)).first()
    own = open_index(docs.sparkSession, rows)
    if middle is not None:
        own.add(digests.filter(F.col("doc_id") <= middle))
    own.add(digests.filter((F.col("doc_id") > middle) | F.col("doc_id").isNull()) if middle is not None else digests)
    return memberships(digests, own)


def unique_documents(docs: DataFrame, members: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of equal texts, with the columns of ``docs``."""
    kept = stored(members.filter("kept").groupBy(
        F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.unhex("text_sha256").alias("digest")).agg(
        F.count("*").alias("n")), "kept")
    own, text = F.col(f"row.{id_col}").cast("bigint"), F.col(f"row.{text_col}")
    keyed = packed(docs).withColumns({
        "id": F.coalesce(own, F.lit(0)), "none": own.isNull(), "digest": F.unhex(F.sha2(normalised(text), 256))})
    found = restricted(keyed, kept, "id", "none", "digest")
    # rows of equal id and text: one of them
    once = found.filter("n > 1").dropDuplicates(["id", "none", "digest"])
    return found.filter("n = 1").unionByName(once).select("row.*") if not kept.filter("n > 1").isEmpty() else found.select("row.*")
