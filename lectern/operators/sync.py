"""Reconciling a file listing with a manifest, and keyed upserts of chunk tables.

Operators return new contents; ``sources.sinks.DealtTable`` writes them, the touched parts of a table only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.base import cut, first_present, present
from .ordering import newest_per_key

#: Up to this many keys are sent to every task, so that rows stay where they are; for more both sides are shuffled.
SENT_KEYS = 500_000


def _instant(c: Column) -> Column:
    return F.try_to_timestamp(c)


def same_version() -> Column:
    """Equality of a listing row ``l`` and a manifest row ``m``.

    Name and path decide first; then the checksums if both are known, else the modification times as
    instants, or as plain text where they are no timestamps."""
    l, m = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"m.{c}"))
    same_name = l("name").eqNullSafe(m("name"))
    same_path = first_present(l("drive_path"), l("name")).eqNullSafe(first_present(m("drive_path"), m("name")))
    now, then = l("modifiedTime"), m("modified_time")
    as_instant = _instant(now).eqNullSafe(_instant(then))
    as_text = now.eqNullSafe(then)
    both_instants = _instant(now).isNotNull() & _instant(then).isNotNull()
    same_time = F.when(both_instants, as_instant).otherwise(as_text)
    sums_known = present(l("md5Checksum")).isNotNull() & present(m("md5_checksum")).isNotNull()
    return same_name & same_path & F.when(
        sums_known, l("md5Checksum") == m("md5_checksum")).otherwise(same_time)


def plan_sync(listing: DataFrame, manifest: DataFrame, seen_at: str | None = None) -> DataFrame:
    """One row per file id: class (new, changed, unchanged, removed), what the file is now and was before.

    Of a repeated id the last row counts: by ``seen_at`` (a column present in both inputs), else by modification time,
    with the other columns of the plan settling ties."""
    plan_columns = {"id": ["name", "drive_path", "mimeType", "md5Checksum"], "drive_file_id": [
        "name", "drive_path", "mime_type", "md5_checksum", "status"]}

    def last(df: DataFrame, key: str, time: str) -> DataFrame:
        by = [F.col(seen_at)] if seen_at else [_instant(F.col(time)), F.col(time)]
        return newest_per_key(df, [key], [*by, *(F.col(c) for c in plan_columns[key])])

    listing, manifest = last(listing, "id", "modifiedTime"), last(manifest, "drive_file_id", "modified_time")
    joined = listing.alias("l").join(manifest.alias("m"), F.col("l.id") == F.col("m.drive_file_id"), "full_outer")
    active = F.coalesce(F.col("m.status") == "active", F.lit(False))
    kind = (
        F.when(F.col("m.drive_file_id").isNull(), F.lit("new"))
        .when(F.col("l.id").isNull(), F.lit("removed"))
        .when(active & same_version(), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    gone = F.col("l.id").isNull()
    pick = lambda a, b: F.when(gone, F.col(f"m.{b}")).otherwise(F.col(f"l.{a}"))
    return joined.select(
        kind.alias("class"),
        pick("id", "drive_file_id").alias("file_id"),
        pick("name", "name").alias("name"),
        pick("drive_path", "drive_path").alias("drive_path"),
        pick("mimeType", "mime_type").alias("mime_type"),
        pick("modifiedTime", "modified_time").alias("modified_time"),
        pick("md5Checksum", "md5_checksum").alias("md5_checksum"),
        F.col("m.chunks_count").alias("chunks_count"),
    ).withColumn("sort_path", F.coalesce(first_present("drive_path", "name"), F.lit("")))


def select_batch(plan: DataFrame, max_files: int | None = None) -> DataFrame:
    """Changed files, then new ones, with ``selected`` true for the first ``max_files`` (None: all); the rest is deferred."""
    pending = plan.filter(F.col("class").isin("changed", "new"))
    if max_files is None:
        return pending.withColumn("selected", F.lit(True))
    if max_files < 1:
        raise ValueError("max_files must be at least 1")
    order = [F.when(F.col("class") == "changed", 0).otherwise(1).alias("_c"), F.col("sort_path"), F.col("file_id")]
    # the batch is bounded by max_files, so it is found by top-n and joined back, not by a global ranking
    batch = pending.orderBy(*order).limit(max_files).select(F.col("file_id").alias("_id"))
    return pending.join(batch, F.col("file_id") == F.col("_id"), "left").select(
        *pending.columns, F.col("_id").isNotNull().alias("selected"))


def unique_names(listing: DataFrame) -> DataFrame:
    return listing.groupBy("name").agg(F.count("*").alias("_n")).filter("_n = 1").select("name")


def jobs_from_plan(plan: DataFrame, listing: DataFrame) -> DataFrame:
    """One job per file to touch: action, id, payload fields and whether old rows of that name may go."""
    lone = unique_names(listing).select(F.col("name").alias("_lone"))
    removed = F.col("class") == "removed"
    jobs = plan.filter(F.col("class") != "unchanged").join(
        lone, (F.col("name") == F.col("_lone")) & ~removed, "left")
    return jobs.select(
        F.when(F.col("class") == "changed", 0).when(F.col("class") == "new", 1).otherwise(2).alias("priority"),
        F.col("class").alias("action"),
        F.col("file_id").alias("drive_file_id"),
        "name",
        F.when(removed, F.coalesce("drive_path", "name")).otherwise(F.col("drive_path")).alias("drive_path"),
        F.when(removed, F.coalesce("mime_type", F.lit("application/octet-stream")))
        .otherwise(F.col("mime_type")).alias("mime_type"),
        F.when(~removed, F.col("_lone").isNotNull()).alias("cleanup_legacy_source"),
    )


def upsert_chunks(target: DataFrame, new: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of the same id. Of a repeated id within ``new`` the largest by ``order`` is written, without an
    order the largest by all columns."""
    return without(target, new.select("id").distinct(), "id").unionByName(each_once(new, order), allowMissingColumns=True)


def each_once(new: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Rows of ``new``, of a repeated id the largest by ``order``, without an order the largest by all columns."""
    # ids alone are counted; whole rows are moved and compared only where one is repeated
    repeated = new.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1 AND id IS NOT NULL").select("id")
    if repeated.isEmpty():
        return new
    several = newest_per_key(new.join(repeated, "id", "left_semi"), ["id"], order or [F.col(c) for c in new.columns if c != "id"])
    return new.join(repeated, "id", "left_anti").unionByName(several.select(*new.columns))


def without(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``table`` whose ``column`` is not among ``keys`` (a table of that column, each key once). Few keys are sent to the rows; with more
    rows are shuffled and looked up, but not sorted."""
    few = keys.limit(SENT_KEYS + 1).count()
    if not few:
        return table
    return table.join(F.broadcast(keys) if few <= SENT_KEYS else keys.hint("shuffle_hash"), column, "left_anti")


def upsert_report(target: DataFrame, new: DataFrame) -> DataFrame:
    """Written rows, and how many of them were inserts."""
    marked = new.select("id").join(target.select(F.col("id").alias("_old")).distinct(), F.col("id") == F.col("_old"), "left")
    return marked.agg(
        F.count("*").alias("written"),
        F.count_if(F.col("_old").isNull()).alias("inserted"),
        F.count_if(F.col("_old").isNotNull()).alias("updated"),
    )


def remove_stale(target: DataFrame, touched_files: DataFrame, current: DataFrame) -> DataFrame:
    """Drop rows of touched files whose id was not written in this run. target: id, drive_file_id, ..."""
    touched = touched_files.select(F.col("drive_file_id").alias("_touched")).distinct()
    written = current.select(F.col("id").alias("_written")).distinct()
    marked = target.join(touched, F.col("drive_file_id") == F.col("_touched"), "left").join(
        written, F.col("id") == F.col("_written"), "left")
    return marked.filter(F.col("_touched").isNull() | F.col("_written").isNotNull()).select(*target.columns)


def remove_legacy(target: DataFrame, processed: DataFrame, listing: DataFrame) -> DataFrame:
    """Drop rows without a file id whose source is a processed file of a unique name."""
    names = processed.select("name").distinct().join(unique_names(listing), "name", "left_semi")
    untracked = present("drive_file_id").isNull()
    return target.join(names, untracked & (F.col("source") == F.col("name")), "left_anti")


def remove_files(target: DataFrame, manifest: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunk table and manifest without the files that left the listing."""
    ids = gone.select("drive_file_id")
    return (
        target.join(ids, "drive_file_id", "left_anti"),
        manifest.join(ids, "drive_file_id", "left_anti"),
    )


def rollback_partial(before: DataFrame, attempted: DataFrame) -> DataFrame:
    """Ids that exist only because of a failed attempt."""
    return attempted.select("id").distinct().join(before.select("id"), "id", "left_anti")


def manifest_rows(results: DataFrame, now: Column) -> DataFrame:
    """Manifest entries from per-file results: id, name, drive_path, mime_type, modified_time, md5_checksum,
    total_chunks, success, status, errors array<string>."""
    clean = F.col("success") & (F.col("status") == "active")
    return results.select(
        F.col("id").alias("drive_file_id"),
        "name",
        F.coalesce("drive_path", "name").alias("drive_path"),
        F.coalesce("mime_type", F.lit("application/octet-stream")).alias("mime_type"),
        F.coalesce(F.try_to_timestamp(present("modified_time")), now).alias("modified_time"),
        "md5_checksum",
        F.col("total_chunks").cast("int").alias("chunks_count"),
        F.when(F.col("success"), F.lit("active")).otherwise(F.lit("error")).alias("status"),
        F.when(F.col("success"), now).alias("last_synced_at"),
        F.when(~clean, cut(F.array_join("errors", "; "), 4000)).alias("last_error"),
        now.alias("updated_at"),
    )


def plan_results(plan: DataFrame) -> DataFrame:
    """Result rows of files that need no work: unchanged ones count their chunks as skipped."""
    chunks = F.coalesce("chunks_count", F.lit(0))
    return plan.filter(F.col("class") == "unchanged").select(
        F.col("file_id").alias("id"), "name", F.lit("unchanged").alias("action"), F.lit(True).alias("success"),
        F.lit("active").alias("status"), F.lit(0).alias("total_pages"), chunks.alias("total_chunks"),
        F.lit(0).alias("inserted"), chunks.alias("skipped"), F.lit(0).alias("removed"),
    )


def report_lines(results: DataFrame) -> DataFrame:
    """One readable line per file."""
    status = (
        F.when(~F.col("success"), F.lit("FALHOU"))
        .when(F.col("status") == "unsupported", F.lit("AVISO")).otherwise(F.lit("OK"))
    )
    return results.select("id", F.format_string(
        "[%s] | %s | %d paginas | %d chunks | %d gravados | %d removidos | acao=%s",
        status, "name", "total_pages", "total_chunks", "inserted", "removed", "action").alias("summary"))


def sync_report(results: DataFrame) -> DataFrame:
    """Totals per action: files, successes, failures, chunks written, skipped and removed."""
    return results.groupBy("action").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("success")).alias("ok"),
        F.count_if(~F.col("success")).alias("failed"),
        F.sum(F.col("inserted").cast("bigint")).alias("inserted"),
        F.sum(F.col("skipped").cast("bigint")).alias("skipped"),
        F.sum(F.col("removed").cast("bigint")).alias("removed"),
    )
