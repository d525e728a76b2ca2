"""Job tables and system health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.base import cut, present
from .ordering import newest_per_key

# Health states from good to bad.
SEVERITY = ["healthy", "warning", "critical"]


def enqueue_jobs(jobs: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Keyed upsert: action and payload replaced; a running job keeps running with its error and lease, others requeue.
    All columns of the stored jobs are kept; a file given more than once is taken once."""
    incoming = new.select("drive_file_id", F.col("action").alias("_action"), F.col("file_info").alias("_info")).dropDuplicates(
        ["drive_file_id"])
    merged = jobs.join(incoming, "drive_file_id", "full_outer")
    given, running = F.col("_action").isNotNull(), F.coalesce(F.col("status") == "running", F.lit(False))
    requeued = given & ~running
    new_values = {
        "action": F.coalesce("_action", "action"),
        "file_info": F.coalesce("_info", "file_info"),
        "status": F.when(requeued, F.lit("queued")).otherwise(F.col("status")),
        "attempts": F.coalesce("attempts", F.lit(0)),
        "max_attempts": F.coalesce("max_attempts", F.lit(3)),
        "last_error": F.when(~requeued, F.col("last_error")),
        "created_at": F.coalesce("created_at", now),
        "updated_at": F.when(given, now).otherwise(F.col("updated_at")),
    }
    if "id" in jobs.columns:  # a new job's id follows from its file, so that a repeated run gives the same
        new_values["id"] = F.coalesce("id", F.concat(F.lit("job-"), F.substring(F.sha2("drive_file_id", 256), 1, 32)))
    return merged.select(*[new_values[c].alias(c) if c in new_values else F.col(c) for c in jobs.columns])


def claimable_jobs(jobs: DataFrame, as_of: Column, n: int | None = None) -> DataFrame:
    """Queued jobs and running ones whose lease ended, oldest first."""
    free = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_expires_at") < as_of))
    found = jobs.filter(free).orderBy("created_at", "id")
    return found if n is None else found.limit(n)


def apply_job_results(jobs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Job table after a run. results: id, error (null = success)."""
    merged = jobs.join(results.select("id", F.col("error").alias("_error"), F.lit(True).alias("_ran")), "id", "left")
    ran = F.coalesce("_ran", F.lit(False))
    failed = ran & F.col("_error").isNotNull()
    exhausted = F.coalesce("attempts", F.lit(0)) >= F.coalesce("max_attempts", F.lit(3))
    status = (
        F.when(~ran, F.col("status")).when(~failed, F.lit("succeeded"))
        .when(exhausted, F.lit("failed")).otherwise(F.lit("queued"))
    )
    return merged.withColumn("last_error", F.when(failed, cut("_error", 4000)).otherwise(F.col("last_error"))).withColumn(
        "completed_at", F.when(ran & ~failed, now)).withColumn(
        "lease_expires_at", F.when(~ran, F.col("lease_expires_at"))).withColumn(
        "updated_at", F.when(ran, now).otherwise(F.col("updated_at"))).withColumn("status", status).drop("_error", "_ran")


def sync_health(jobs: DataFrame) -> DataFrame:
    """Jobs per status, newest success, oldest running job and the newest error text (180 characters)."""
    at = F.col("updated_at")
    is_ = lambda s: F.col("status") == s
    error = F.when(is_("failed"), present("last_error"))
    return jobs.agg(
        *[F.count_if(is_(s)).alias(s) for s in ("queued", "running", "succeeded", "failed")],
        F.max(F.when(is_("succeeded"), at)).alias("last_success_at"),
        F.min(F.when(is_("running"), at)).alias("oldest_running_at"),
        cut(F.max_by(error, F.when(error.isNotNull(), F.struct(at, F.col("id")))), 180).alias("last_error"),
    )


def severity(status: Column | str) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col(status) if isinstance(status, str) else status)


def _worst(level: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in SEVERITY]), (level - 1).cast("int")), F.lit("unknown"))


def _count_check(table: DataFrame | None, component: str, key: str, failing: Column | None, spark) -> DataFrame:
    """One health row of a component; an unreadable table (None) is critical."""
    if table is None:
        return spark.range(1).select(
            F.lit(component).alias("component"), F.lit("critical").alias("status"),
            F.lit(f'{{"error":"{component} unreadable"}}').alias("detail"))
    counted = (table if failing is None else table.filter(failing)).agg(F.count("*").alias("n"))
    bad = F.lit(False) if failing is None else F.col("n") > 0
    return counted.select(
        F.lit(component).alias("component"),
        F.when(bad, F.lit("warning")).otherwise(F.lit("healthy")).alias("status"),
        F.concat(F.lit(f'{{"{key}":'), F.col("n").cast("string"), F.lit("}")).alias("detail"))


def health_check(
    documents: DataFrame | None, jobs: DataFrame | None, evaluations: DataFrame | None, as_of: Column, spark
) -> DataFrame:
    """One row per component with its status, a JSON detail and the time of the check."""
    failed = F.col("status") == "failed"
    rows = _count_check(documents, "supabase", "indexed_documents", None, spark).unionByName(
        _count_check(jobs, "drive_sync", "failed_jobs", failed, spark)).unionByName(
        _count_check(evaluations, "quality_worker", "failed_evaluations", failed, spark))
    return rows.withColumn("checked_at", as_of)


def overall_status(checks: DataFrame) -> DataFrame:
    return checks.agg(_worst(F.max(severity("status"))).alias("status"))


def latest_health(checks: DataFrame, limit: int | None = 30, order: tuple[str, ...] = ("checked_at",)) -> DataFrame:
    """Newest check per component among the last ``limit`` checks; with None among all, so that a busy component hides no other."""
    recent = checks if limit is None else checks.orderBy(*[F.desc(c) for c in order]).limit(limit)
    recent = recent.filter(present("component").isNotNull())
    return newest_per_key(recent, ["component"], [F.col(c) for c in order])


def monitoring_summary(checks: DataFrame, limit: int | None = 30, order: tuple[str, ...] = ("checked_at",)) -> DataFrame:
    """Overall status, time of the newest check and the alerting components (at most one per component)."""
    latest = latest_health(checks, limit, order)
    alerting = F.col("status").isin("warning", "critical")
    alerts = F.array_sort(F.collect_list(F.when(alerting, F.concat("component", F.lit("="), "status"))))
    return latest.agg(
        _worst(F.max(severity("status"))).alias("status"), F.max("checked_at").alias("last_check_at"),
        F.array_join(alerts, ",").alias("alerts"))


def stuck_jobs(jobs: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """Jobs running longer than the given time."""
    return jobs.filter((F.col("status") == "running") & (F.col("updated_at") < as_of - F.make_interval(hours=F.lit(hours))))
