import random

import pytest
from pyspark.sql import functions as F

from lectern import schemas
from lectern.operators import jobs, metrics, ordering, quality
from lectern.plans import panel

META = {f.name: None for f in schemas.TURN_METADATA.fields}


def message(i, session="s", role="assistant", content="x", at="2024-01-01 10:00:00", request=None, meta="none", **fields):
    from datetime import datetime

    metadata = None if meta is None or (meta == "none" and not fields) else {**META, **fields}
    return (str(i), session, request, role, content, datetime.fromisoformat(at), metadata)


@pytest.fixture
def messages(spark):
    return lambda *rows: spark.createDataFrame(list(rows), schemas.MESSAGES)


def latency(total):
    return {"embedding": 1.0, "retrieval": 2.0, "generation": 3.0, "total": total}


def test_synthetic_prefixes(spark):
    ids = ["acceptance-flow-001-abc", "semantic-probe-abc", "course-plan-check-abc", "course-plan-final-abc", "test-e2e-session-abc", "audit_session_abc",
           "real_test_answer-abc", "session-monitor-check-abc", "student-session-abc", "session-enf-001", "Test-x", None, ""]
    df = spark.createDataFrame([(i,) for i in ids], "session_id string")
    assert [r.session_id for r in metrics.exclude_synthetic(df).collect()] == ids[8:]


def test_sessions(messages):
    df = messages(
        message(1, "a", "user", "", "2024-01-01 09:00:00"), message(2, "a", "user", "Primeira", "2024-01-01 09:01:00"),
        message(3, "a", "assistant", "x", "2024-01-01 09:02:00", mode="quiz", current_topic="  feridas "),
        message(4, "a", "assistant", "x", "2024-01-01 09:03:00", mode="info", current_topic=" "),
        message(5, None, "user", "sobre ANESTESIA e hemostasia", "2024-01-02 00:00:00"), message(6, "", "user", "b", "2024-01-02 00:00:01"),
        message(7, "c", "assistant", "fala de estomas", current_topic="ignorado sem modo"))
    got = {r.session_id: r for r in metrics.sessions(df).collect()}
    a, unknown, c = got["a"], got["unknown"], got["c"]
    assert (a.first_message, a.mode, a.theme, a.message_count) == ("Primeira", "info", "feridas", 4)
    assert (unknown.message_count, unknown.theme, unknown.mode) == (2, "Hemostasia", None)
    assert (c.theme, c.first_message) == ("Estomas", "")


def test_empty_rates_are_zero(messages):
    df = messages()
    assert tuple(metrics.quiz_stats(df).first()) == (0, 0, 0, 0)
    assert tuple(metrics.context_coverage(df).first()) == (0, 0, 0)
    assert tuple(metrics.latency_percentiles(df).first()) == (0, 0)
    assert tuple(metrics.latency_percentiles(df, approximate=True).first()) == (0, 0)
    assert tuple(metrics.latency_averages(df).first()) == (0, 0, 0, 0)
    assert [r.turns for r in metrics.mode_counts(df).collect()] == [0] * 4
    assert tuple(metrics.technical_failures(df).first()) == (0,)


def test_latency_samples(spark, messages):
    df = messages(*[message(i, latency_ms=latency(v)) for i, v in enumerate([10.0, 20.0, 30.0, 40.0, -1.0, float("nan"), float("inf"), None])], message(99, meta=None))
    assert tuple(metrics.latency_percentiles(df).first()) == (20, 40)
    assert metrics.turn_counts(df).first().latency_samples == 4
    assert metrics.latency_averages(df).first().avg_total_ms == 25


def test_json_null_counts_as_zero_and_missing_does_not(spark):
    raw = ['{"latency_ms":{"total":null}}', '{"latency_ms":{}}', '{}', None, '{"latency_ms":{"total":"12"}}', '{"latency_ms":{"total":"a"}}', '{"latency_ms":{"total":3.5}}',
           '{"latency_ms":{"total":-1}}', '{"latency_ms":{"total":""}}', "no json"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = [r.v for r in df.select("i", metrics.json_latency_sample("raw", "total").alias("v")).orderBy("i").collect()]
    assert got == [0.0, None, None, None, 12.0, None, 3.5, None, 0.0, None]


@pytest.mark.parametrize("buckets, scale", [(2, 1.0), (40, 1e6), (200, 1.0)])
def test_nearest_rank_is_exact(spark, buckets, scale):
    rng = random.Random(5)
    values = [scale * rng.choice([7.25, rng.random() * 300]) for _ in range(997)]
    got = ordering.nearest_rank(spark.createDataFrame([(v,) for v in values], "v double"), "v", {"p1": 1, "p50": 50, "p95": 95, "p100": 100}, buckets).first()
    ordered = sorted(values)
    rank = lambda p: round(ordered[min(len(ordered) - 1, -(-p * len(ordered) // 100) - 1)])
    assert tuple(got) == (rank(1), rank(50), rank(95), rank(100))


def test_positions_over_buckets(spark):
    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(400), i) for i in range(1500)] + [(None, 3, 9000), (None, 1, 9001)]
    # no time, one instant, a burst after an outlier
    data += [("hot", None, 9100 + i) for i in range(90)] + [("instant", 7, 9300 + i) for i in range(120)]
    data += [("burst", 0, 9500)] + [("burst", 10 ** 6, 9501 + i) for i in range(150)]
    def key(d): return (d[1] is not None, d[1] or 0, d[2])
    df = spark.createDataFrame(data, "k string, t int, i int")
    want = {}
    for k in {d[0] for d in data}:
        for n, (_, _, i) in enumerate(sorted((d for d in data if d[0] == k), key=key), 1):
            want[i] = n
    for rows_per_bucket in (1, 40, 10_000):
        got = ordering.ordered_position(df, ["k"], [F.asc("t"), F.asc("i")], "n", rows_per_bucket)
        assert {r.i: r.n for r in got.collect()} == want
        before = ordering.previous_value(df, ["k"], ["t", "i"], "i", "p", rows_per_bucket)
        previous = {}
        for k in {d[0] for d in data}:
            chain = [None] + [i for _, _, i in sorted((d for d in data if d[0] == k), key=key)]
            previous.update(zip(chain[1:], chain))
        assert {r.i: r.p for r in before.collect()} == previous
    sizes = [r["count"] for r in ordering.in_ranges(df, [F.col("k"), F.col("t"), F.col("i")], 100).groupBy("_range").count().collect()]
    assert max(sizes) <= 200
    total = ordering.global_position(df, [F.desc("t"), F.asc("i")], "n", 100)
    order = sorted(data, key=lambda d: (d[1] is None, -(d[1] or 0), d[2]))
    assert [r.i for r in total.orderBy("n").collect()] == [d[2] for d in order]


def test_pipeline_turns_can_leave_out_navigation(messages):
    df = messages(message(1, has_context=False, latency_ms={**latency(5.0), "embedding": 0.0}), message(2, has_context=True, latency_ms=latency(5.0)), message(3, mode="x"))
    assert metrics.pipeline_turns(df).count() == 2 and metrics.pipeline_turns(df, exclude_navigation=True).count() == 1
    assert tuple(metrics.context_coverage(df).first()) == (2, 1, 50)


def test_sources(spark):
    df = spark.createDataFrame([("Biblioteca__livro_a.pdf",), ("Biblioteca__livro_a.pdf",), ("plano-de_ensino__x",), (None,), ("",), ("__x",)], "source string")
    got = {r.source: (r.chunk_count, r.category) for r in metrics.source_inventory(df).collect()}
    assert got == {"Biblioteca__livro_a.pdf": (2, "Biblioteca"), "plano-de_ensino__x": (1, "plano de ensino"), metrics.NO_SOURCE: (2, metrics.NO_SOURCE), "__x": (1, metrics.NO_CATEGORY)}
    share = metrics.library_share(df).first()
    assert (share.total_chunks, share.library_chunks, share.library_percent) == (6, 2, 33.3)
    assert metrics.library_share(df.limit(0)).first().library_percent == 0


def test_calendar_and_hours(messages):
    df = messages(message(1, at="2024-01-01 23:59:59"), message(2, at="2024-01-03 00:00:00"), message(3, at="2023-12-01 00:00:00"))
    got = [(r.date, r.messages) for r in metrics.timeline_filled(df, "2024-01-03", 7).orderBy("date").collect()]
    assert got[-3:] == [("2024-01-01", 1), ("2024-01-02", 0), ("2024-01-03", 1)] and len(got) == 7 and sum(n for _, n in got) == 2
    assert metrics.activity_hourly(df).filter("messages > 0").count() == 2


FEEDBACK = "session_id string, request_id string, rating string, created_at string"
UID = "123e4567-e89b-42d3-a456-426614174000"


def test_feedback(spark):
    raw = spark.createDataFrame(
        [(" s ", UID, "5", "2024-01-01 00:00:00"), ("s", UID, "2", "2024-01-02 00:00:00"), (None, "bad", " 4 ", "2024-01-01 00:00:00"), ("", "bad", "3.0", "2024-01-01 00:00:00"),
         ("s", None, "6", "2024-01-01 00:00:00"), ("s", None, "4.5", "2024-01-01 00:00:00"), ("s", None, "abc", "2024-01-01 00:00:00"), ("s", None, None, "2024-01-01 00:00:00"),
         ("x" * 200, None, "1", "2024-01-01 00:00:00")], FEEDBACK).withColumn("created_at", F.to_timestamp("created_at"))
    clean = quality.clean_feedback(raw)
    assert {(r.session_id, r.request_id, r.rating) for r in clean.collect()} == {
        ("s", UID, 5), ("s", UID, 2), ("anonymous", None, 4), ("anonymous", None, 3), ("x" * 128, None, 1)}
    kept = quality.upsert_feedback(clean)
    rows = sorted([(r.session_id[:9], r.rating) for r in kept.collect()])
    assert rows == [("anonymous", 3), ("anonymous", 4), ("s", 2), ("xxxxxxxxx", 1)]
    stats = quality.rating_stats(kept).first()
    assert (stats.total_feedbacks, stats.avg_rating, stats.satisfaction_rate, stats.stars_4) == (4, 2.5, 25, 1)
    assert quality.rating_stats(kept.limit(0)).first().avg_rating == 0.0
    sessions = spark.createDataFrame([("s",), ("t",)], "session_id string")
    assert {r.session_id: (r.avg_rating, r.rating_count) for r in quality.session_rating(sessions, kept).collect()} == {"s": (2.0, 1), "t": (None, 0)}


def test_evaluation_parsing(spark):
    raw = ['{"score": 120.9, "verdict": "correct", "grounding_score": "85", "completeness_score": -4, "rationale": "' + "a" * 500 + '"}', '{"verdict": "great"}', "no json", '{"verdict": "unverifiable"}']
    got = quality.parse_eval(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")).orderBy("i").collect()
    assert (got[0].score, got[0].grounding_score, got[0].completeness_score, got[0].relevance_score, len(got[0].rationale)) == (100, 85, 0, 0, 400)
    assert [g.error for g in got] == [None, "INVALID_EVALUATOR_VERDICT", "INVALID_EVALUATOR_VERDICT", None]
    assert got[3].score == 0 and got[1].verdict is None


def test_evaluation_lifecycle(spark, messages):
    now = F.to_timestamp(F.lit("2024-05-01 00:00:00"))
    table = spark.createDataFrame([("s", "r1", "succeeded", 1, "old", "correct", 90)], "session_id string, request_id string, status string, attempts int, updated_at string, verdict string, score int").withColumn(
        "updated_at", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    turns = spark.createDataFrame([("s", "r1", 2, None), ("s", "r2", 1, None), ("s", "r2", 1, None), ("s", "r3", 0, None), ("s", "r4", 1, "MODEL_FAILED")],
                                  "session_id string, request_id string, sources_found int, generation_error string")
    once = quality.eval_enqueue(table, turns, now)
    got = {r.request_id: (r.status, r.updated_at.month) for r in once.collect()}
    assert got == {"r1": ("succeeded", 5), "r2": ("queued", 5)}
    assert once.columns == table.columns
    assert {r.request_id: (r.verdict, r.score) for r in once.collect()} == {"r1": ("correct", 90), "r2": (None, None)}
    assert quality.eval_enqueue(once, turns, now).count() == 2
    ran = spark.createDataFrame([("r1", 1, 3, None), ("r2", 2, 3, "e" * 2000), ("r3", 3, 3, "e")], "request_id string, attempts int, max_attempts int, error string")
    out = {r.request_id: (r.status, len(r.last_error or ""), r.completed_at is not None) for r in quality.eval_outcome(ran, now).collect()}
    assert out == {"r1": ("succeeded", 0, True), "r2": ("queued", 1000, False), "r3": ("failed", 1, False)}
    m = messages(message(1, request="r1", has_context=True), message(2, request="r2", has_context=True), message(3, request="r3", has_context=False), message(4, has_context=True))
    evaluations = spark.createDataFrame([("s", "r1", "succeeded", "correct"), ("s", "r3", "succeeded", "incorrect"), ("s", "r2", "queued", None)], "session_id string, request_id string, status string, verdict string")
    assert tuple(quality.quality_coverage(m, evaluations).first()) == (2, 1, 50)
    s = quality.quality_summary(evaluations).first()
    assert (s.completed, s.queued, s.correct_rate) == (2, 1, 50)
    assert quality.quality_summary(evaluations.limit(0)).first().correct_rate == 0


def test_evaluation_material(spark):
    turns = spark.createDataFrame([("s", "r", [("2", "x"), ("", "x"), ("source:x:3", "x"), ("9", "x"), ("1", "x")])],
                                  "session_id string, request_id string, retrieval array<struct<document_id:string,source:string>>")
    docs = spark.createDataFrame([(1, "a.pdf", "A" * 7000), (2, "b.pdf", "B")], "id int, source string, content string")
    got = quality.eval_material(quality.eval_context(turns, docs)).first()
    assert got.source_count == 2
    assert got.material == "[Fonte: b.pdf]\nB\n\n---\n\n[Fonte: a.pdf]\n" + "A" * 6000


JOBS = "id string, drive_file_id string, action string, file_info string, status string, attempts int, max_attempts int, lease_expires_at timestamp, last_error string, created_at timestamp, updated_at timestamp"


def job_table(spark):
    from datetime import datetime as d

    return spark.createDataFrame(
        [("1", "f1", "new", "{}", "running", 1, 3, d(2024, 1, 1, 1), "e1", d(2024, 1, 1), d(2024, 1, 1, 0, 30)), ("2", "f2", "new", "{}", "failed", 3, 3, None, "e" * 300, d(2024, 1, 2), d(2024, 1, 2)),
         ("3", "f3", "new", "{}", "succeeded", 1, 3, None, None, d(2024, 1, 3), d(2024, 1, 3)), ("4", "f4", "new", "{}", "queued", 0, 3, None, None, d(2023, 1, 3), d(2024, 1, 3))], JOBS)


def test_jobs(spark):
    now = F.to_timestamp(F.lit("2024-01-01 01:30:01"))
    table = job_table(spark)
    new = spark.createDataFrame([("f1", "changed", "n"), ("f2", "changed", "n"), ("f9", "new", "n")], "drive_file_id string, action string, file_info string")
    got = {r.drive_file_id: (r.action, r.status, r.last_error) for r in jobs.enqueue_jobs(table, new, now).collect()}
    assert got == {"f1": ("changed", "running", "e1"), "f2": ("changed", "queued", None), "f3": ("new", "succeeded", None), "f4": ("new", "queued", None), "f9": ("new", "queued", None)}
    queued = jobs.enqueue_jobs(table, new.union(new), now)
    assert queued.columns == table.columns and {r.drive_file_id: r.lease_expires_at is not None for r in queued.collect()}["f1"]
    ids = {r.drive_file_id: r.id for r in queued.collect()}
    assert {ids[f] for f in ("f1", "f2", "f3", "f4")} == {"1", "2", "3", "4"} and ids["f9"]
    assert [r.id for r in jobs.claimable_jobs(queued, now).collect()] == ["4", "1", ids["f9"], "2"]
    assert [r.id for r in jobs.claimable_jobs(table, now).collect()] == ["4", "1"]
    assert [r.id for r in jobs.claimable_jobs(table, now, 1).collect()] == ["4"]
    assert [r.id for r in jobs.stuck_jobs(table, now).collect()] == ["1"]
    results = spark.createDataFrame([("1", "x" * 5000), ("4", None)], "id string, error string")
    done = {r.id: (r.status, len(r.last_error or "")) for r in jobs.apply_job_results(table, results, now).collect()}
    assert done == {"1": ("queued", 4000), "2": ("failed", 300), "3": ("succeeded", 0), "4": ("succeeded", 0)}
    h = jobs.sync_health(table).first()
    assert (h.queued, h.running, h.succeeded, h.failed, len(h.last_error), h.last_success_at.day, h.oldest_running_at.minute) == (1, 1, 1, 1, 180, 3, 30)


def test_health(spark):
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    checks = jobs.health_check(spark.range(3), job_table(spark), None, at, spark)
    assert {r.component: r.status for r in checks.collect()} == {"supabase": "healthy", "drive_sync": "warning", "quality_worker": "critical"}
    assert jobs.overall_status(checks).first().status == "critical"
    m = jobs.monitoring_summary(checks).first()
    assert (m.status, m.alerts) == ("critical", "drive_sync=warning,quality_worker=critical")
    assert jobs.monitoring_summary(checks.limit(0)).first().status == "unknown"


def test_a_busy_component_hides_no_other_without_a_limit(spark):
    checks = spark.createDataFrame([("rare", "warning", 0), *(("busy", "healthy", i) for i in range(1, 60))], "component string, status string, checked_at int")
    assert {r.component for r in jobs.latest_health(checks).collect()} == {"busy"}
    assert {r.component: r.checked_at for r in jobs.latest_health(checks, limit=None).collect()} == {"rare": 0, "busy": 59}


def test_panel_indicators(spark, messages):
    m = messages(message(1, "s", request="r", has_context=True, mode="quiz", state_after="QUIZ_CONCLUIDO", latency_ms=latency(10.0)), message(2, "test-1"))
    chunks = spark.createDataFrame([("biblioteca__a",)], "source string")
    evaluations = spark.createDataFrame([("s", "r", "succeeded", "correct")], "session_id string, request_id string, status string, verdict string")
    feedback = spark.createDataFrame([("s", "r", 5)], "session_id string, request_id string, rating int")
    got = {r.name: r.value for r in panel.indicators(m, chunks, evaluations, feedback, job_table(spark)).collect()}
    assert (got["conversations"], got["p50"], got["coverage_rate"], got["accuracy_rate"], got["correct_rate"], got["satisfaction_rate"], got["library_percent"]) == (1, 10, 100, 100, 100, 100, 100)
