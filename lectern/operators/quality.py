"""Learner feedback and automatic answer evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.base import cut, first_present, half_up, join_sorted, matches, percent, present, strip
from ..functions.identity import UUID_V1_TO_V5
from ..session import written
from .metrics import Measures, measured, pipeline_turns
from .ordering import newest_per_key

TURN = ["session_id", "request_id"]
VERDICTS = ["correct", "incomplete", "incorrect", "unverifiable"]
STATUSES = ["queued", "running", "succeeded", "failed"]
# Fixed value: how much of a chunk an evaluator reads.
MATERIAL_CHARS = 6000
SCORES = ["score", "grounding_score", "completeness_score", "relevance_score"]


def clean_feedback(raw: DataFrame) -> DataFrame:
    """Valid ratings only: whole numbers 1 to 5. Bad request ids become null, a missing session 'anonymous'."""
    number = strip(F.col("rating").cast("string")).try_cast("double")
    whole = (number == F.floor(number)) & number.between(1, 5)
    return raw.filter(F.coalesce(whole, F.lit(False))).select(
        first_present(cut(strip("session_id"), 128), F.lit("anonymous")).alias("session_id"),
        F.when(matches("request_id", UUID_V1_TO_V5), F.col("request_id")).alias("request_id"),
        number.cast("int").alias("rating"),
        "created_at",
    )


def upsert_feedback(feedback: DataFrame) -> DataFrame:
    """The last rating of each (session, request) counts; ratings without a request all count."""
    keyed = F.col("request_id").isNotNull()
    last = newest_per_key(feedback.filter(keyed), TURN, [F.col("created_at"), F.col("rating")])
    return last.unionByName(feedback.filter(~keyed))


def session_rating(session_rows: DataFrame, feedback: DataFrame) -> DataFrame:
    """Adds the mean rating to one decimal (null if none) and the number of ratings."""
    rated = feedback.groupBy("session_id").agg(
        F.round(F.avg("rating"), 1).alias("avg_rating"), F.count("*").alias("rating_count"))
    return session_rows.join(rated, "session_id", "left").withColumn("rating_count", F.coalesce("rating_count", F.lit(0)))


def rating_stats(feedback: DataFrame) -> DataFrame:
    """One row: stars 1 to 5, average over all rows and share of 4 and 5 stars."""
    star = lambda n: F.count_if(F.col("rating") == n)
    valid = F.col("rating").between(1, 5)
    everything = F.count("*")
    total = F.coalesce(F.sum(F.when(valid, F.col("rating"))), F.lit(0))
    return feedback.agg(
        *[star(n).alias(f"stars_{n}") for n in (5, 4, 3, 2, 1)],
        everything.alias("total_feedbacks"),
        F.round(F.coalesce(F.try_divide(total.cast("double"), everything), F.lit(0.0)), 1).alias("avg_rating"),
        percent(star(5) + star(4), everything).alias("satisfaction_rate"),
    )


def rating_by_mode(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """Ratings joined to the answers they are about, per mode."""
    turns = messages.filter((F.col("role") == "assistant") & F.col("request_id").isNotNull()).select(
        *TURN, F.col("metadata.mode").alias("mode"))
    joined = feedback.filter(F.col("request_id").isNotNull()).join(turns, TURN)
    return joined.groupBy(F.coalesce("mode", F.lit("none")).alias("mode")).agg(
        F.count("*").alias("ratings"), F.round(F.avg("rating"), 2).alias("avg_rating"),
        percent(F.count_if(F.col("rating") >= 4), F.count("*")).alias("satisfaction_rate"))


#: Ids of wanted chunks that are sent to every task at most.
SENT_IDS = 500_000
#: Bytes of their texts that are sent to every task at most, and entries that then meet their texts in one task.
SENT_BYTES, TASK_ENTRIES = 64_000_000, 30_000


def eval_context(turns: DataFrame, documents: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Stored chunks behind each answer, in retrieval order. turns: session, request, retrieval array.

    Entries without an id or with a ``source:`` stand-in have no stored chunk. Out: one row per chunk, its text
    cut to ``max_chars`` before it is moved."""
    entries = turns.select(*TURN, F.posexplode("retrieval").alias("pos", "e")).select(
        *TURN, "pos", F.col("e.document_id").alias("document_id"))
    stored = entries.filter(present("document_id").isNotNull() & ~F.col("document_id").startswith("source:"))
    # few wanted ids are sent to the documents, so that no other text is moved; many meet their texts by shuffle
    wanted = stored.select("document_id").distinct()
    id_of = F.col("id").cast("string")
    few = wanted.limit(SENT_IDS + 1).count() <= SENT_IDS
    if few:
        documents = documents.join(F.broadcast(wanted.withColumnRenamed("document_id", "_wanted")), id_of == F.col("_wanted"), "left_semi")
    chunks = documents.select(id_of.alias("document_id"), "source", cut("content", max_chars).alias("content") if max_chars else F.col("content"))
    if few:
        # short lists of texts go to the entries, which are dealt by turn before, so that no copy of a text is shuffled
        chunks = written(chunks, "chunks")
        if chunks.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0] <= SENT_BYTES:
            return stored.repartition(-(-stored.count() // TASK_ENTRIES) or 1, *TURN).join(F.broadcast(chunks), "document_id")
    return stored.join(chunks, "document_id")


def eval_material(context: DataFrame) -> DataFrame:
    """Text an evaluator reads per answer (at most k chunks, each cut to 6000 characters) and its source count."""
    text = F.concat(F.lit("[Fonte: "), "source", F.lit("]\n"), cut("content", MATERIAL_CHARS))
    return context.groupBy(*TURN).agg(
        join_sorted(F.struct("pos", text.alias("text")), "\n\n---\n\n").alias("material"),
        F.count("*").alias("source_count"))


def parse_eval(raw: DataFrame, json: str = "raw") -> DataFrame:
    """Evaluator output parsed: scores truncated and clamped to 0..100, rationale cut; a bad verdict is an error."""
    doc = F.try_parse_json(json)
    field = lambda name, kind: F.try_variant_get(doc, f"$.{name}", kind)
    verdict = field("verdict", "string")
    ok = F.coalesce(verdict.isin(VERDICTS), F.lit(False))
    score = lambda name: F.when(ok, F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(
        field(name, "double").cast("bigint"), F.lit(0)))).cast("int"))
    return raw.select(
        "*", F.when(ok, verdict).alias("verdict"), *[score(s).alias(s) for s in SCORES],
        F.when(ok, cut(F.coalesce(field("rationale", "string"), F.lit("")), 400)).alias("rationale"),
        F.when(~ok, F.lit("INVALID_EVALUATOR_VERDICT")).alias("error"),
    )


def eval_outcome(jobs: DataFrame, now: Column) -> DataFrame:
    """Next state of evaluation rows. jobs: keys, attempts, max_attempts, error (null = success), scores."""
    ok = F.col("error").isNull()
    exhausted = F.coalesce("attempts", F.lit(0)) >= F.coalesce("max_attempts", F.lit(3))
    replaced = ("status", "completed_at", "updated_at", "lease_expires_at", "last_error", "error")
    return jobs.select(
        *[c for c in jobs.columns if c not in replaced],
        F.when(ok, F.lit("succeeded")).when(exhausted, F.lit("failed")).otherwise(F.lit("queued")).alias("status"),
        F.when(ok, now).alias("completed_at"),
        now.alias("updated_at"),
        F.lit(None).cast("timestamp").alias("lease_expires_at"),
        F.when(~ok, cut("error", 1000)).alias("last_error"),
    )


def eval_enqueue(evaluations: DataFrame, turns: DataFrame, now: Column) -> DataFrame:
    """Evaluation table after queueing the turns with documents and no generation error.

    New keys are queued; rows that exist are only touched and keep all their columns. turns: keys, sources_found, generation_error."""
    eligible = turns.filter((F.col("sources_found") > 0) & F.col("generation_error").isNull()).select(*TURN).distinct()
    asked = eligible.withColumn("_asked", F.lit(True))
    merged = evaluations.join(asked, TURN, "full_outer")
    new_values = {
        "status": F.coalesce("status", F.lit("queued")), "attempts": F.coalesce("attempts", F.lit(0)),
        "updated_at": F.when(F.col("_asked"), now).otherwise(F.col("updated_at")),
    }
    return merged.select(*[new_values[c].alias(c) if c in new_values else F.col(c) for c in evaluations.columns])


def quality_measures() -> Measures:
    status = lambda s: F.count_if(F.col("status") == s)
    verdict = lambda v: F.count_if(F.col("verdict") == v)
    return Measures({
        "total": F.count("*"), **{"completed" if s == "succeeded" else s: status(s) for s in STATUSES}, **{v: verdict(v) for v in VERDICTS},
        "correct_rate": percent(verdict("correct"), status("succeeded"))})


def quality_summary(evaluations: DataFrame) -> DataFrame:
    """Evaluations by status and verdict, and the share of correct ones among the completed."""
    return measured(evaluations, quality_measures())


def quality_coverage(messages: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Eligible turns (context found, request known), how many were evaluated, in percent."""
    one, none = F.lit(1).alias("eligible"), F.lit(0).alias("eligible")
    eligible = pipeline_turns(messages).filter(F.col("metadata.has_context") & F.col("request_id").isNotNull()).select(*TURN, one, F.lit(0).alias("done"))
    judged = evaluations.filter(F.col("status") == "succeeded").select(*TURN, none, F.lit(1).alias("done"))
    # one row per turn and map task is moved, of both tables at once
    turns = eligible.unionByName(judged).groupBy(*TURN).agg(F.sum("eligible").alias("eligible"), F.sum("done").alias("done"))
    known = (F.col("eligible") > 0) & F.col("session_id").isNotNull()
    counted = turns.agg(F.coalesce(F.sum("eligible"), F.lit(0)).alias("eligible_turns"),
                        F.coalesce(F.sum(F.when(known, F.col("done"))), F.lit(0)).alias("evaluated_turns"))
    return counted.select("eligible_turns", "evaluated_turns",
                          percent(F.col("evaluated_turns"), F.col("eligible_turns")).alias("coverage_rate"))


def attach_quality(messages: DataFrame, evaluations: DataFrame, feedback: DataFrame) -> DataFrame:
    """Messages of both roles with the evaluation and the learner's rating of their turn."""
    judged = evaluations.select(*TURN, F.col("status").alias("evaluation_status"), "verdict", "score")
    rated = feedback.filter(F.col("request_id").isNotNull()).select(*TURN, F.col("rating").alias("learner_rating"))
    return messages.join(judged, TURN, "left").join(rated, TURN, "left")
