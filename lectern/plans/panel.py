"""The panel: the indicators of each table in one aggregate, and the two export tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import audit, jobs as job_ops, metrics, quality


def indicators(
    messages: DataFrame, chunks: DataFrame, evaluations: DataFrame, feedback: DataFrame, jobs: DataFrame
) -> DataFrame:
    """Indicator rows (name, value) of the export's first sheet.

    Each source table is reduced to one row by one aggregate; only percentiles and the evaluated share of turns, which need
    an order or a second table, are found by themselves."""
    messages = metrics.exclude_synthetic(messages)
    evaluations, feedback = metrics.exclude_synthetic(evaluations), metrics.exclude_synthetic(feedback)
    parts = [
        metrics.measured(
            messages, metrics.total_measures(), metrics.turn_measures(), metrics.coverage_measures(), metrics.failure_measures(),
            metrics.quiz_measures(), metrics.guardrail_measures()).drop("correct", "first_attempt_retries", "second_attempt_resolved"),
        metrics.latency_percentiles(messages),
        quality.quality_summary(evaluations).select("completed", "correct", "unverifiable", "correct_rate"),
        quality.quality_coverage(messages, evaluations).select("eligible_turns", "evaluated_turns", F.col("coverage_rate").alias("evaluation_coverage")),
        quality.rating_stats(feedback).select("total_feedbacks", "avg_rating", "satisfaction_rate"),
        metrics.library_share(chunks), job_ops.sync_health(jobs).select(F.col("running").alias("jobs_running"), F.col("failed").alias("jobs_failed")),
    ]
    rows = None
    for part in parts:
        cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in part.columns])
        exploded = part.select(F.explode(cells).alias("c")).select("c.name", "c.value")
        rows = exploded if rows is None else rows.unionByName(exploded)
    return rows


def session_rows(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Sessions of real learners with their ratings."""
    known = metrics.sessions(metrics.exclude_synthetic(messages))
    return quality.session_rating(known, feedback)


def session_sheet(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """The export's second sheet."""
    return audit.session_report(session_rows(messages, feedback))
