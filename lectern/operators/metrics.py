"""Panel metrics over messages and chunks. Callers pass messages that went through ``exclude_synthetic``."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.base import first_present, half_up, matches, percent, present, ratio, strip
from .ordering import nearest_rank

# Id prefixes of sessions made by tests and probes.
SYNTHETIC_PREFIXES = [
    "acceptance-", "semantic-probe-", "course-plan-check-", "course-plan-final-", "test-", "test_", "audit-",
    "audit_", "real_test_", "session-monitor-", "info-session-",
]
DEFAULT_THEME = "Geral Enfermagem"
# Keywords that name a session's theme, in order of precedence.
THEMES = {
    "Hemostasia": ["hemostasia"],
    "Feridas": ["ferida"],
    "Cirurgia Bariátrica": ["bariatrica", "bariátrica"],
    "Anestesia": ["anestesia"],
    "Estomas": ["estoma"],
    "Pré-operatório": ["pre-operatorio", "pré-operatório"],
    "Pós-operatório": ["pos-operatorio", "pós-operatório"],
    "Posicionamento": ["posicionamento"],
}
PANEL_MODES = ["resumo", "quiz", "info", "livre"]
# Phrases of refusals, and the error codes counted as retrieval or model failures.
REFUSALS = ["não posso responder a essa solicitação", "fora do escopo da disciplina"]
RETRIEVAL_ERRORS = ["EMBEDDING_FAILED", "RETRIEVAL_FAILED", "NO_RELEVANT_CONTEXT"]
MODEL_ERROR = "MODEL_FAILED"
STAGES = ["embedding", "retrieval", "generation", "total"]
NO_SOURCE = "Fonte não identificada"
NO_CATEGORY = "Material RAG"


def is_synthetic(session_id: Column | str) -> Column:
    return matches(session_id, "^(?:" + "|".join(SYNTHETIC_PREFIXES) + ")")


def exclude_synthetic(df: DataFrame, session_id: str = "session_id") -> DataFrame:
    """Rows of real sessions; a missing session id is kept."""
    return df.filter(~is_synthetic(session_id))


def _contains(text: Column, word: str) -> Column:
    return F.contains(text, F.lit(word))


def sessions(messages: DataFrame) -> DataFrame:
    """One row per session: times, message count, first user text, last mode, theme.

    One aggregation; first and last values are picked by (created_at, id) inside it."""
    at = F.struct("created_at", "id")
    spoken = (F.col("role") == "assistant") & present("metadata.mode").isNotNull()
    topic = F.when(spoken, present(strip("metadata.current_topic")))
    asked = F.when(F.col("role") == "user", present("content"))
    # one bit per theme whose keyword occurs in the message, so that a session needs a single bit_or
    named = F.lit(0)
    for i, words in enumerate(THEMES.values()):
        hit = F.lit(False)
        for w in words:
            hit = hit | _contains(F.col("_lower"), w)
        named = named + F.when(hit, F.lit(1 << i)).otherwise(F.lit(0))
    known = messages.withColumn("session_id", first_present("session_id", F.lit("unknown"))).withColumn("_lower", F.lower("content"))
    grouped = known.groupBy("session_id").agg(
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
        F.count("*").alias("message_count"),
        F.coalesce(F.min_by(asked, F.when(asked.isNotNull(), at)), F.lit("")).alias("first_message"),
        F.max_by("metadata.mode", F.when(spoken, at)).alias("mode"),
        F.max_by(topic, F.when(topic.isNotNull(), at)).alias("_topic"),
        F.bit_or(named).alias("_named"),
    )
    # a stored topic equal to the default counts as none
    theme = F.when(F.col("_topic") != DEFAULT_THEME, F.col("_topic"))
    for i, name in enumerate(THEMES):
        theme = theme.when(F.col("_named").bitwiseAND(1 << i) != 0, F.lit(name))
    return grouped.select(
        "session_id", "first_at", "last_at", "message_count", "first_message", "mode",
        theme.otherwise(F.lit(DEFAULT_THEME)).alias("theme"))


def _moded(messages: DataFrame) -> DataFrame:
    return messages.filter((F.col("role") == "assistant") & present("metadata.mode").isNotNull())


def mode_counts(messages: DataFrame) -> DataFrame:
    """Assistant turns per mode; the four known modes always appear."""
    spark = messages.sparkSession
    known = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in PANEL_MODES])).alias("mode"))
    counted = _moded(messages).groupBy(F.col("metadata.mode").alias("mode")).agg(F.count("*").alias("turns"))
    return known.join(counted, "mode", "full_outer").select("mode", F.coalesce("turns", F.lit(0)).alias("turns"))


def topic_counts(messages: DataFrame) -> DataFrame:
    topic = present(strip("metadata.current_topic"))
    return _moded(messages).select(topic.alias("topic")).filter("topic is not null").groupBy("topic").agg(
        F.count("*").alias("turns"))


def top_topics(messages: DataFrame, n: int = 10) -> DataFrame:
    return topic_counts(messages).orderBy(F.desc("turns"), "topic").limit(n)


class Measures(NamedTuple):
    """Named aggregates over rows of one table. Each holds its own condition, so that measures of different rows are found in one pass."""

    columns: dict[str, Column]


def measured(rows: DataFrame, *measures: Measures) -> DataFrame:
    """All measures of a table in one aggregate: one row."""
    columns = {name: column for m in measures for name, column in m.columns.items()}
    return rows.agg(*[column.alias(name) for name, column in columns.items()])


def quiz_measures() -> Measures:
    before, after = F.col("metadata.state_before"), F.col("metadata.state_after")
    quiz = (F.col("role") == "assistant") & (F.col("metadata.mode") == "quiz")
    correct, retries = F.count_if(quiz & (after == "QUIZ_CONCLUIDO")), F.count_if(quiz & (after == "QUIZ_SEGUNDA_TENTATIVA"))
    resolved = F.count_if(quiz & (before == "QUIZ_SEGUNDA_TENTATIVA") & (after == "QUIZ_EM_ANDAMENTO"))
    return Measures({"correct": correct, "first_attempt_retries": retries, "second_attempt_resolved": resolved,
                     "accuracy_rate": percent(correct, correct + retries + resolved)})


def quiz_stats(messages: DataFrame) -> DataFrame:
    """Completed quizzes, first-attempt retries, second attempts resolved, and completed in percent of all."""
    return measured(messages, quiz_measures())


def guardrail_measures() -> Measures:
    lower = F.lower("content")
    return Measures({"guardrail_hits": F.count_if(_contains(lower, REFUSALS[0]) | _contains(lower, REFUSALS[1]))})


def guardrail_hits(messages: DataFrame) -> DataFrame:
    return measured(messages, guardrail_measures())


def timeline_daily(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("created_at").isNotNull()).groupBy(
        F.date_format("created_at", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("messages"))


def timeline_filled(messages: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """The last ``days`` UTC days up to ``as_of``, days without messages as 0."""
    last = F.to_date(F.lit(as_of))
    calendar = messages.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    window = messages.filter(F.to_date("created_at").between(F.date_sub(last, days - 1), last))
    counted = window.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counted, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("date"), F.coalesce("n", F.lit(0)).alias("messages"))


def activity_hourly(messages: DataFrame) -> DataFrame:
    """Messages per hour of the day, all 24 hours."""
    hours = messages.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    counted = messages.groupBy(F.hour("created_at").alias("hour")).agg(F.count("*").alias("n"))
    return hours.join(counted, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("messages"))


def total_measures() -> Measures:
    conversations = F.count_distinct(first_present("session_id", F.lit("unknown")))
    return Measures({"conversations": conversations, "messages": F.count("*"), "unique_users": conversations})


def totals(messages: DataFrame) -> DataFrame:
    """Conversations (also taken as unique users) and messages."""
    return measured(messages, total_measures())


def instrumented(messages: DataFrame) -> DataFrame:
    """Assistant rows that carry telemetry, even an empty one."""
    return messages.filter((F.col("role") == "assistant") & F.col("metadata").isNotNull())


def pipeline_turns(messages: DataFrame, exclude_navigation: bool = False) -> DataFrame:
    """Instrumented rows that say whether context was found.

    Navigation replies say so too (always false); ``exclude_navigation`` leaves out those without any search
    time."""
    rows = instrumented(messages).filter(F.col("metadata.has_context").isNotNull())
    if exclude_navigation:
        rows = rows.filter(F.col("metadata.latency_ms.embedding") > 0)
    return rows


def _is_instrumented() -> Column:
    return (F.col("role") == "assistant") & F.col("metadata").isNotNull()


def turn_measures() -> Measures:
    told, sample = F.col("metadata.has_context").isNotNull(), latency_sample("total").isNotNull()
    return Measures({
        "instrumented_responses": F.count_if(_is_instrumented()), "pipeline_turns": F.count_if(_is_instrumented() & told),
        "latency_samples": F.count_if(_is_instrumented() & sample)})


def turn_counts(messages: DataFrame) -> DataFrame:
    return measured(messages, turn_measures())


def latency_sample(stage: str) -> Column:
    """A stage's latency if it is a finite number of at least 0."""
    value = F.col(f"metadata.latency_ms.{stage}").cast("double")
    ok = ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    return F.when(ok, value)


def json_latency_sample(metadata: Column | str, stage: str) -> Column:
    """The same from raw JSON text: JSON null and '' count as 0, a missing key as no sample, numeric strings parse."""
    value = F.try_variant_get(F.try_parse_json(metadata), f"$.latency_ms.{stage}", "variant")
    text = strip(F.try_variant_get(value, "$", "string"))
    number = F.when(F.is_variant_null(value) | (text == ""), F.lit(0.0)).otherwise(text.try_cast("double"))
    return F.when(value.isNotNull() & ~F.isnan(number) & (number >= 0) & (number < float("inf")), number)


def latency_percentiles(messages: DataFrame, stage: str = "total", approximate: bool = False) -> DataFrame:
    """P50 and P95 by nearest rank, rounded; 0 without samples. ``approximate`` uses a mergeable sketch."""
    samples = instrumented(messages).select(latency_sample(stage).alias("v"))
    if approximate:
        p = F.percentile_approx("v", [0.5, 0.95], 10_000)
        return samples.agg(p.alias("p")).select(
            *[F.coalesce(F.round(F.get("p", F.lit(i))), F.lit(0)).cast("bigint").alias(n) for i, n in enumerate(("p50", "p95"))])
    return nearest_rank(samples, "v", {"p50": 50, "p95": 95})


def latency_averages(messages: DataFrame) -> DataFrame:
    """Mean latency per stage, rounded half up; 0 without samples."""
    return instrumented(messages).agg(*[
        half_up(F.coalesce(F.avg(latency_sample(s)), F.lit(0.0))).alias(f"avg_{s}_ms") for s in STAGES])


def _is_pipeline() -> Column:
    return _is_instrumented() & F.col("metadata.has_context").isNotNull()


def coverage_measures() -> Measures:
    found = F.count_if(_is_pipeline() & F.col("metadata.has_context"))
    turns = F.count_if(_is_pipeline())
    return Measures({"pipeline_turns": turns, "with_context": found, "coverage_rate": percent(found, turns)})


def context_coverage(messages: DataFrame) -> DataFrame:
    return measured(messages, coverage_measures())


def failure_measures() -> Measures:
    error, count = F.col("metadata.error_code"), lambda c: F.count_if(_is_pipeline() & c)
    return Measures({
        "fallback_turns": count(F.col("metadata.fallback_used")), "no_context_turns": count(~F.col("metadata.has_context")),
        "retrieval_failures": count(error.isin(RETRIEVAL_ERRORS)), "model_failures": count(error == MODEL_ERROR)})


def failure_counts(messages: DataFrame) -> DataFrame:
    """Fallbacks, answers without context, retrieval and model failures, and the two failure kinds together."""
    return measured(messages, failure_measures())


def technical_failures(messages: DataFrame) -> DataFrame:
    return failure_counts(messages).select(
        (F.col("retrieval_failures") + F.col("model_failures")).alias("technical_failures"))


def source_summary(chunks: DataFrame) -> DataFrame:
    """Chunks per source; a missing source gets a fixed label."""
    return chunks.groupBy(first_present("source", F.lit(NO_SOURCE)).alias("source")).agg(F.count("*").alias("chunk_count"))


def source_inventory(chunks: DataFrame) -> DataFrame:
    """Source summary with the category its name starts with."""
    category = F.translate(F.substring_index("source", "__", 1), "_-", "  ")
    return source_summary(chunks).withColumn("category", first_present(category, F.lit(NO_CATEGORY)))


def library_share(chunks: DataFrame, prefix: str = "biblioteca") -> DataFrame:
    """Chunks of library sources and their percentage to one decimal."""
    counted = source_summary(chunks)
    library = F.coalesce(F.sum(F.when(F.lower("source").startswith(prefix), F.col("chunk_count"))), F.lit(0))
    everything = F.coalesce(F.sum("chunk_count"), F.lit(0))
    return counted.agg(
        F.count("*").alias("total_sources"), everything.alias("total_chunks"), library.alias("library_chunks"),
        percent(library, everything, 1).alias("library_percent"))


def search_sessions(session_rows: DataFrame, term: str = "", mode: str = "all") -> DataFrame:
    """Sessions whose id, first message or theme contains the term, newest first."""
    wanted = F.lit(term.lower())
    hit = F.lit(False)
    for c in ("session_id", "first_message", "theme"):
        hit = hit | F.contains(F.lower(c), wanted)
    if mode != "all":
        hit = hit & F.coalesce(F.col("mode") == mode, F.lit(False))
    return session_rows.filter(hit).orderBy(F.desc("last_at"), "session_id")


def shares(counts: DataFrame, value: str) -> DataFrame:
    """Adds ``percent`` of the column's total (at least 1). counts: one row per category."""
    total = F.greatest(F.sum(value).over(Window.partitionBy()), F.lit(1))
    return counts.withColumn("percent", half_up(F.lit(100.0) * ratio(F.col(value), total), 1))


def similarity_distribution(messages: DataFrame, width: float = 0.1) -> DataFrame:
    """Retrieved chunks per similarity bucket and number of sources of the turn."""
    hits = instrumented(messages).select(
        F.col("metadata.sources_found").alias("sources_found"), F.explode("metadata.retrieval.similarity").alias("s"))
    return hits.groupBy(F.floor(F.col("s") / width).alias("bucket"), "sources_found").agg(F.count("*").alias("hits"))


def latency_by_model(messages: DataFrame) -> DataFrame:
    """Samples and rounded mean latency per stage and model."""
    return instrumented(messages).groupBy(F.coalesce("metadata.model_used", F.lit("none")).alias("model")).agg(
        F.count("*").alias("turns"),
        *[half_up(F.coalesce(F.avg(latency_sample(s)), F.lit(0.0))).alias(f"avg_{s}_ms") for s in STAGES])


def fallback_by_reason(messages: DataFrame) -> DataFrame:
    return pipeline_turns(messages).filter(F.col("metadata.fallback_used")).groupBy(
        F.coalesce("metadata.fallback_reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("turns"))
