"""Corpus reconciliation as one plan: which files changed, their text, chunks, vectors and the new chunk table."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.base import present
from ..functions.identity import chunk_record_id
from ..operators import chunking, references, retrieval, sync
from ..session import written
from ..sources.files import NO_TEXT, extract_pages
from ..sources.sinks import DealtTable

NO_CONTENT = "file content is missing"
#: Up to this many chosen files are sent to the contents, which then stay where they are; for more both sides are shuffled.
SENT_FILES = sync.SENT_KEYS


def chunk_rows(files: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """Chunk table rows of extracted files: file_id, source, pages, modified_time, drive_path."""
    keep = ["file_id", "modified_time", "drive_path", "reference"]
    described = references.extract_reference_metadata(files)
    chunks = chunking.chunk_recursive(described, size, overlap, keep)
    return chunks.select(
        chunk_record_id("file_id", "page_number", "chunk_index", "content_hash").alias("id"), "content", "source",
        F.col("file_id").alias("drive_file_id"), "page_number", "chunk_index", "content_hash",
        F.col("modified_time").alias("drive_modified_time"), "drive_path",
        *[F.col(f"reference.{n}").alias(f"reference_{n}") for n in ("author", "year", "title", "section")])


class Reconciled(NamedTuple):
    """What a run leaves: the chunk table, the manifest, a row per file, totals per action, and the plan it followed."""

    table: DataFrame
    manifest: DataFrame
    results: DataFrame
    report: DataFrame
    plan: DataFrame


def chosen_contents(chosen: DataFrame, contents: DataFrame | DealtTable) -> DataFrame:
    """The stored rows of ``chosen`` (file_id, ...) with their ``content``, null where there is none.

    Of a table dealt by ``id`` only the parts of chosen files are read, and bytes are moved for files only whose id has several
    contents; of those the one with the smallest SHA-256 counts."""
    if isinstance(contents, DealtTable):
        contents = contents.read(contents.touched(chosen.select(F.col("file_id").alias(contents.key[0]))))
    contents = contents.select(F.col("id").alias("_id"), "content")
    few = chosen.count() <= SENT_FILES
    wanted = chosen.select(F.col("file_id").alias("_id"))
    wanted = F.broadcast(wanted) if few else wanted
    # ids alone are read for this
    found = written(contents.select("_id").join(wanted, "_id", "left_semi").groupBy("_id").agg(F.count("*").alias("_n")), "found")
    known = chosen.join(found, F.col("file_id") == F.col("_id"))
    once, several = (known.filter(c).drop("_n") for c in ("_n = 1", "_n > 1"))
    if few:
        once, several = F.broadcast(once), F.broadcast(several)
    else:  # contents are looked up, not sorted
        once = once.hint("shuffle_hash")
    columns = [*chosen.columns, "content"]
    parts = [contents.join(once, "_id").select(*columns)]
    if not found.filter("_n > 1").isEmpty():
        repeated = contents.join(several.select("_id"), "_id", "left_semi").groupBy("_id").agg(F.min_by("content", F.sha2("content", 256)).alias("content"))
        parts.append(known.filter("_n > 1").drop("_n").join(repeated, "_id").select(*columns))
    parts.append(chosen.join(found, F.col("file_id") == F.col("_id"), "left_anti").withColumn("content", F.lit(None).cast("binary")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def reconcile(
    listing: DataFrame, manifest: DataFrame, contents: DataFrame | DealtTable, target: DataFrame, extractor: Callable,
    embed: Callable, dim: int, max_files: int | None = None, now: Column | None = None, plan: DataFrame | None = None,
    size: int = 1000, overlap: int = 150,
) -> Reconciled:
    """Bring chunk table and manifest up to the listing. contents: id, content (bytes) of any files, best as a table dealt by id.

    Chosen files (all new and changed ones, or the first ``max_files``) end in one of three ways. A file with text gets its
    new chunks, and those of before that it no longer has go; so do rows of its name without a file id. A file without any
    text is ``unsupported``: its chunks go. A file that cannot be extracted, or whose bytes are missing, has failed: its
    chunks and rows stay as they were, and the manifest records the error, so that the next run tries again. Files that left the
    listing lose chunks and manifest row. Chunks are cut and embedded once and stored."""
    now = F.current_timestamp() if now is None else now
    plan = written(sync.plan_sync(listing, manifest), "plan") if plan is None else plan
    chosen = written(sync.select_batch(plan, max_files).filter("selected").drop("selected", "sort_path"), "chosen")
    todo = chosen_contents(chosen, contents)
    missing = F.col("content").isNull().alias("missing")
    files = extract_pages(todo.select("*", missing), extractor)
    error = F.when(F.col("missing"), F.lit(NO_CONTENT)).otherwise(F.col("extract_error"))
    # stored, so that files are extracted once
    files = written(files.withColumn("error", error).withColumn("source", F.col("name")), "files")
    fresh = written(retrieval.embed(chunk_rows(files.filter(F.col("error").isNull()), size, overlap), embed, dim), "fresh")

    cut = fresh.groupBy(F.col("drive_file_id").alias("_cut")).agg(F.count("*").alias("chunks"))
    outcome = written(files.select(
        "file_id", "class", "name", "drive_path", "mime_type", "modified_time", "md5_checksum", "error",
        F.size("pages").alias("pages")).join(cut, F.col("file_id") == F.col("_cut"), "left").drop("_cut"), "outcome")
    done = outcome.filter(F.col("error").isNull())
    gone = plan.filter(F.col("class") == "removed").select(F.col("file_id").alias("drive_file_id"))
    table = _kept(target, done, gone, fresh, listing).unionByName(sync.each_once(fresh), allowMissingColumns=True)

    results = _results(outcome, target, fresh).unionByName(
        sync.plan_results(plan).withColumn("errors", F.array().cast("array<string>")), allowMissingColumns=True).unionByName(
        _removed(gone, plan, target), allowMissingColumns=True)
    entries = sync.manifest_rows(results.filter(F.col("action").isin("new", "changed")), now)
    kept = manifest.join(entries.select("drive_file_id"), "drive_file_id", "left_anti").join(gone, "drive_file_id", "left_anti")
    stored_types = dict(manifest.dtypes)
    entries = entries.select(*[F.col(c).cast(stored_types[c]) if c in stored_types else F.col(c) for c in entries.columns])
    return Reconciled(table, kept.unionByName(entries, allowMissingColumns=True), results, sync.sync_report(results), plan)


def reconcile_into(
    table: DealtTable, listing: DataFrame, manifest: DataFrame, contents: DataFrame | DealtTable, extractor: Callable, embed: Callable, dim: int,
    **options,
) -> Reconciled:
    """``reconcile`` on a table dealt by file: only the parts of files that are new, changed or gone, and of their names, are read
    and written. Before the first run the table need not exist."""
    plan = written(sync.plan_sync(listing, manifest), "plan")
    moved = plan.filter("class <> 'unchanged'")
    no_text = F.lit(None).cast("string")
    touched = table.touched(moved.select(F.col("file_id").alias("drive_file_id"), no_text.alias("source")).union(
        moved.select(no_text.alias("drive_file_id"), F.col("name").alias("source"))))
    empty = table.spark.createDataFrame([], "id string, drive_file_id string, source string")
    run = reconcile(listing, manifest, contents, table.read(touched) if table.exists() else empty, extractor, embed, dim, plan=plan, **options)
    # what tells of the rows before the change is found before it
    run = run._replace(manifest=written(run.manifest, "manifest"), results=written(run.results, "results"))
    if touched or not table.exists():
        table.replace(run.table, touched)
    return run._replace(table=table.read(), report=sync.sync_report(run.results))


def _kept(target: DataFrame, done: DataFrame, gone: DataFrame, fresh: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows of before that stay: those of a file that is done or gone go, so do others with the id of a new chunk, and rows without a file that carry
    the unique name of a file that is done. Rows are moved for none of this while the files are few."""
    leaving = written(done.select(F.col("file_id").alias("drive_file_id")).union(gone).distinct(), "leaving")
    # ids are made from the file, so hardly ever does a row of another file have one
    others = target.select("id", "drive_file_id").join(fresh.select("id"), "id", "left_semi").join(leaving, "drive_file_id", "left_anti")
    rows = sync.without(sync.without(target, leaving, "drive_file_id"), written(others.select("id").distinct(), "others"), "id")
    tracked = present("drive_file_id").isNotNull()
    return rows.filter(tracked).unionByName(sync.remove_legacy(rows.filter(~tracked), done, listing))


def _results(outcome: DataFrame, target: DataFrame, fresh: DataFrame) -> DataFrame:
    """A row per chosen file; ``removed`` counts rows that its new chunks replaced by none of the same id."""
    stored = target.select("id", F.col("drive_file_id").alias("_file")).join(fresh.select("id"), "id", "left_anti").groupBy("_file").agg(
        F.count("*").alias("stale"))
    failed, unsupported = F.col("error").isNotNull(), F.col("error").isNull() & (F.col("pages") == 0)
    number = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return outcome.join(stored, F.col("file_id") == F.col("_file"), "left").select(
        F.col("file_id").alias("id"), "name", F.col("class").alias("action"), (~failed).alias("success"),
        F.when(failed, F.lit("error")).when(unsupported, F.lit("unsupported")).otherwise(F.lit("active")).alias("status"),
        number(F.col("pages")).alias("total_pages"), number(F.col("chunks")).alias("total_chunks"),
        number(F.col("chunks")).alias("inserted"), F.lit(0).alias("skipped"), number(F.when(~failed, F.col("stale"))).alias("removed"),
        "drive_path", "mime_type", "modified_time", "md5_checksum",
        F.when(failed, F.array("error")).when(unsupported, F.array(F.lit(NO_TEXT))).otherwise(F.array().cast("array<string>")).alias("errors"))


def _removed(gone: DataFrame, plan: DataFrame, target: DataFrame) -> DataFrame:
    """A row per file that left the listing, with the number of its chunks."""
    chunks = target.join(gone, "drive_file_id", "left_semi").groupBy(F.col("drive_file_id").alias("_file")).agg(F.count("*").alias("n"))
    files = plan.filter(F.col("class") == "removed")
    return files.join(chunks, F.col("file_id") == F.col("_file"), "left").select(
        F.col("file_id").alias("id"), "name", F.lit("removed").alias("action"), F.lit(True).alias("success"), F.lit("removed").alias("status"),
        F.lit(0).alias("total_pages"), F.lit(0).alias("total_chunks"), F.lit(0).alias("inserted"), F.lit(0).alias("skipped"),
        F.coalesce("n", F.lit(0)).cast("int").alias("removed"), F.array().cast("array<string>").alias("errors"))
