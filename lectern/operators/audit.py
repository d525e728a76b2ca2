"""Audit export, session dossiers and acceptance checks.

A session can be arbitrarily long, so nested or joined-up output comes in numbered parts of bounded size;
the parts of a session in order make up its whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.base import join_sorted, present
from ..functions.identity import anonymize_session
from .ordering import BUCKET_ROWS, global_position, ordered_position

RULE = "=" * 60
THIN_RULE = "-" * 60


def audit_window(messages: DataFrame, start: str, end: str) -> DataFrame:
    """Messages between two instants, both included."""
    first, last = F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
    ordered = F.assert_true(first <= last, "start must not be after end").isNull()
    return messages.filter(ordered & F.col("created_at").between(first, last))


def _instrumented() -> Column:
    return (F.col("role") == "assistant") & F.col("metadata.latency_ms").isNotNull()


def audit_summary(messages: DataFrame) -> DataFrame:
    return messages.agg(
        F.count_distinct(anonymize_session("session_id")).alias("sessions"), F.count("*").alias("messages"),
        F.count_if(_instrumented()).alias("instrumented_turns"))


def error_code_counts(messages: DataFrame) -> DataFrame:
    return messages.filter(_instrumented()).select(present("metadata.error_code").alias("error_code")).filter(
        "error_code is not null").groupBy("error_code").agg(F.count("*").alias("turns"))


def numbered_messages(messages: DataFrame, name: str = "number", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Messages numbered from 1 within their session by (created_at, id)."""
    return ordered_position(
        messages, ["session_id"], [F.asc("created_at"), F.asc("id")], name, bucket_rows)


def audit_sessions(messages: DataFrame, part_size: int = 1000) -> DataFrame:
    """Messages nested per anonymised session, ``part_size`` per row."""
    numbered = numbered_messages(messages)
    entry = F.struct(
        F.col("number"), F.col("id").alias("message_id"), "role", "content",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"),
        F.struct("metadata.has_context", "metadata.sources_found", "metadata.error_code", "metadata.latency_ms").alias("telemetry"))
    part = F.floor((F.col("number") - 1) / part_size) + 1
    return numbered.groupBy(anonymize_session("session_id").alias("case_candidate"), part.alias("part")).agg(
        F.array_sort(F.collect_list(entry)).alias("messages"))


def session_dossier(
    messages: DataFrame, session_rows: DataFrame, title: str, part_size: int = 200
) -> DataFrame:
    """Transcript text of each session in numbered parts; part 1 starts with the header."""
    clock = lambda c, pattern: F.date_format(c, pattern)
    header = F.concat(
        F.lit(f"{RULE}\n{title}\n{RULE}\nID Sessão: "), "session_id",
        F.lit("\nData Início: "), clock("first_at", "dd/MM/yyyy, HH:mm:ss"),
        F.lit("\nÚltima Atividade: "), clock("last_at", "dd/MM/yyyy, HH:mm:ss"),
        F.lit("\nTema Detectado: "), "theme",
        F.lit("\nTotal Interações: "), F.col("message_count").cast("string"),
        F.lit(f"\n{RULE}\n\n"))
    who = F.when(F.col("role") == "user", F.lit("ESTUDANTE")).otherwise(F.lit("TUTOR DE ENFERMAGEM"))
    text = F.concat(
        F.lit("[#"), F.col("number").cast("string"), F.lit("] "), who, F.lit(" ("), clock("created_at", "HH:mm:ss"),
        F.lit("):\n"), "content", F.lit(f"\n{THIN_RULE}\n\n"))
    part = F.floor((F.col("number") - 1) / part_size) + 1
    parts = numbered_messages(messages).groupBy("session_id", part.alias("part")).agg(
        join_sorted(F.struct(F.col("number").alias("pos"), text.alias("text")), "").alias("body"))
    return parts.join(session_rows, "session_id").select(
        "session_id", "part", F.concat(F.when(F.col("part") == 1, header).otherwise(F.lit("")), "body").alias("text"))


def session_report(session_rows: DataFrame) -> DataFrame:
    """Sessions numbered newest first, with a dash for a missing rating and a default first message.

    session_rows: output of ``metrics.sessions`` with ``avg_rating``."""
    numbered = global_position(session_rows, [F.desc("last_at"), F.asc("session_id")], "number")
    clock = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return numbered.select(
        "number", F.concat(F.lit("#"), F.lpad(F.col("number").cast("string"), F.greatest(F.lit(2), F.length(F.col("number").cast("string"))), F.lit("0"))).alias("label"),
        "session_id", clock("first_at").alias("started_at"), clock("last_at").alias("last_activity"), "message_count", "theme",
        F.when(F.coalesce(F.col("avg_rating"), F.lit(0.0)) != 0, F.format_string("%.1f", "avg_rating")).otherwise(F.lit("—")).alias("rating"),
        F.coalesce(present("first_message"), F.lit("Menu Inicial")).alias("first_message"))


def check_answers(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Failures of each acceptance case. results: id, status, answer, sources_found, elapsed_ms."""
    joined = cases.select("id", "expect").join(results, "id", "left")
    answer = F.lower(F.coalesce("answer", F.lit("")))
    found = F.coalesce("sources_found", F.lit(0))
    listed = lambda name: F.coalesce(F.col(f"expect.{name}"), F.array().cast("array<string>"))
    missing = F.transform(
        F.filter(listed("includes"), lambda x: ~F.contains(answer, F.lower(x))),
        lambda x: F.concat(F.lit('não contém "'), x, F.lit('"')))
    unwanted = F.transform(
        F.filter(listed("excludes"), lambda x: F.contains(answer, F.lower(x))),
        lambda x: F.concat(F.lit('contém "'), x, F.lit('"')))
    text = lambda c: c.cast("string")
    single = F.array_compact(F.array(
        F.when(found < F.coalesce("expect.sourcesMin", F.lit(0)),
               F.concat(F.lit("fontes "), text(found), F.lit(" < "), text(F.col("expect.sourcesMin")))),
        F.when(F.col("elapsed_ms") > F.col("expect.maxLatencyMs"),
               F.concat(F.lit("latência "), text(F.col("elapsed_ms")), F.lit("ms > "), text(F.col("expect.maxLatencyMs")), F.lit("ms"))),
    ))
    http = F.when(F.coalesce(F.col("status") != 200, F.lit(True)),
                  F.array(F.concat(F.lit("HTTP "), F.coalesce(text(F.col("status")), F.lit("?"))))).otherwise(
        F.array().cast("array<string>"))
    failures = F.concat(http, missing, unwanted, single)
    return joined.select("id", failures.alias("failures"), (F.size(failures) == 0).alias("passed"),
                         F.coalesce("elapsed_ms", F.lit(0)).alias("elapsed_ms"), found.alias("sources"))


def acceptance_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count("*").alias("total"))


def regression_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Outcome of each case in two runs: fixed, broken, same, added or dropped."""
    b, a = before.select("id", F.col("passed").alias("was")), after.select("id", F.col("passed").alias("now"))
    change = (
        F.when(F.col("was").isNull(), F.lit("added")).when(F.col("now").isNull(), F.lit("dropped"))
        .when(F.col("was") & ~F.col("now"), F.lit("broken")).when(~F.col("was") & F.col("now"), F.lit("fixed"))
        .otherwise(F.lit("same"))
    )
    return b.join(a, "id", "full_outer").select("id", "was", "now", change.alias("change"))
