"""Streams against their batch twins: any order of delivery, late and repeated rows, state that ends."""

import random
from datetime import datetime, timedelta

from checks import normalized
from pyspark.sql import functions as F
from test_flow import STATES, TURNS, by_turn, random_turns

from lectern.operators import dedup, flow
from lectern.streaming import turns as streams

LATER = 3_600_000


class Deliveries:
    """Rows that arrive in a folder, one file at a time, and the stream that is run after each."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), spark.createDataFrame([], schema).schema

    def write(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def stream(self):
        return streams.read_stream(self.spark, f"{self.folder}/in", self.schema)

    def decide(self, rows, wait_ms=LATER, states=None):
        self.write(rows)
        streams.run_live_sessions(streams.live_sessions(self.stream(), wait_ms, states), f"{self.folder}/out")

    def decisions(self):
        return by_turn(streams.read_decisions(self.spark, f"{self.folder}/out"))

    def late(self):
        rows = streams.read_late_turns(self.spark, f"{self.folder}/out").collect()
        return sorted(((r.session_id, r.turn, r.message) for r in rows), key=lambda r: (r[0], r[1] is not None, r[1] or 0))


def test_shuffled_and_repeated_delivery_equals_batch(spark, tmp_path):
    data = random_turns(4, 12)
    shuffled = [*data, *data[::3]]
    random.Random(3).shuffle(shuffled)
    arriving = Deliveries(spark, tmp_path, TURNS)
    for part in range(3):
        arriving.decide(shuffled[part::3])
    assert arriving.decisions() == by_turn(flow.fold_turns(spark.createDataFrame(data, TURNS)))
    assert arriving.late() == []


def test_a_turn_waits_for_those_before_it_and_late_ones_are_kept(spark, tmp_path):
    data = {i: ("s", i, m, None, False) for i, m in enumerate(["Quiz sobre feridas", "B", "A", "Voltar ao menu", "Olá", "encerrar"])}
    other = [("t", i, f"oi {i}", None, False) for i in range(9)]
    arriving = Deliveries(spark, tmp_path, TURNS)
    arriving.decide([data[1], data[2], other[0]], wait_ms=0)
    # without any wait turn 0 is given up at once; 1 and 2 go on from the start
    assert [d[1] for d in arriving.decisions() if d[0] == "s"] == [1, 2]
    arriving.decide([data[4], ("s", None, "no number", None, False), ("s", -1, "below", None, False)])  # 4 waits for 3
    assert [d[1] for d in arriving.decisions() if d[0] == "s"] == [1, 2]
    arriving.decide([data[3], data[2], other[1]])
    arriving.decide([data[0], data[5], data[0]])
    arriving.decide([data[0], data[4]])
    decided = [d[1] for d in arriving.decisions() if d[0] == "s"]
    late = arriving.late()
    assert ("s", 0, "Quiz sobre feridas") in late and ("s", None, "no number") in [x for x in late if x[1] is None] and ("s", -1, "below") in late
    # every delivered turn is decided or late, and once only
    assert sorted(decided) == [1, 2, 3, 4, 5] and [x[1] for x in late if x[1] is not None] == [-1, 0]
    in_time = [data[i] for i in decided]
    batch = by_turn(flow.fold_turns(spark.createDataFrame(in_time, TURNS)))
    assert [d for d in arriving.decisions() if d[0] == "s"] == batch


def test_a_stream_goes_on_from_stored_states(spark, tmp_path):
    stored = [("s", "QUIZ_EM_ANDAMENTO", "quiz", "feridas", 2, 1, 40), ("u", "LIVRE", "livre", "", 0, 0, 3)]
    states = spark.createDataFrame(stored, STATES)
    data = [("s", 7, "B", None, False), ("s", 8, "A", None, False), ("t", 0, "oi", None, False), ("u", 0, "oi", None, False)]
    arriving = Deliveries(spark, tmp_path, TURNS)
    upto = F.when(F.col("session_id") == "s", F.lit(6))
    arriving.decide([data[1], *data[2:]], states=states.withColumn("turn", upto))
    arriving.decide(data[:1], states=states.withColumn("turn", upto))
    assert arriving.decisions() == by_turn(flow.fold_turns(spark.createDataFrame(data, TURNS), states))


def test_given_up_turns_are_known_one_by_one():
    session = streams.LiveSession()
    session.missing = [3, 7, 9, 9]
    assert [session._given_up(t) for t in (2, 5, 5, 3, 9, 9, 8, 7)] == [False, True, False, True, True, False, False, True]
    assert session.missing == [4, 4, 6, 6]


MESSAGES = "id string, session_id string, request_id string, role string, created_at timestamp"


def test_state_of_unique_turns_ends(spark, tmp_path):
    t = datetime(2024, 1, 1)
    arriving, every = Deliveries(spark, tmp_path, MESSAGES), []
    for n in range(12):
        rows = [(f"{n}-{i}", "s", f"{n}-{i}", "user", t + timedelta(minutes=n)) for i in range(10)]
        # a redelivery in the same file, a retried write of an old turn that was written earlier, rows without a request
        rows += rows[:3] + [(f"again-{n}", "s", f"{max(0, n - 5)}-0", "user", t - timedelta(minutes=n))] + [(f"free-{n}", "s", None, "user", t)] * 2
        every += rows
        arriving.write(rows)
    progress = streams.run_unique_turns(arriving.stream(), str(tmp_path / "out"), delay="0 seconds")
    held = [op["numRowsTotal"] for p in progress for op in p["stateOperators"]]
    assert len(held) == 12 and max(held) <= 33  # of three files at most; all twelve bring 132
    assert sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"]) == 0
    got = streams.read_unique_turns(spark, str(tmp_path / "out"), arriving.schema).toPandas()
    whole = spark.createDataFrame(every, arriving.schema)
    assert normalized(got) == normalized(dedup.dedup_turns(whole).toPandas())


METADATA = "struct<latency_ms: struct<total: double>>"


def test_windows_are_closed_once(spark, tmp_path):
    day = lambda n, h=0: datetime(2024, 1, 1) + timedelta(days=n, hours=h)
    schema = spark.createDataFrame([], "created_at timestamp, role string, beat boolean").schema
    arriving = Deliveries(spark, tmp_path, schema)
    arriving.write([(day(0), "user", False), (day(0, 5), "user", False), (day(1), "user", False)])
    arriving.write([(day(0, 7), "user", False), (day(4), "user", False), (None, "user", False)])
    arriving.write([(day(4, 1), "user", False)])
    arriving.write([(day(1, 3), "user", False), (day(5), "user", False)])  # day 1 is closed by now: too late
    arriving.write([(day(30), None, True)])
    path = str(tmp_path / "out")
    plain = arriving.stream().withColumn("metadata", F.lit(None).cast(METADATA))
    late = streams.run_activity(streams.windowed_activity(plain, "1 day", "1 day", F.col("beat")), path)
    got = streams.read_appended(spark, path, spark.createDataFrame([], "window_start timestamp, messages long, latency_samples long, avg_total_ms long").schema)
    assert sorted((r.window_start, r.messages) for r in got.collect()) == [(day(0), 3), (day(1), 1), (day(4), 2), (day(5), 1)]
    assert late == 1
    before = len(list((tmp_path / "out" / "data").glob("*.parquet")))
    assert streams.run_activity(streams.windowed_activity(plain, "1 day", "1 day", F.col("beat")), path) == 0
    assert len(list((tmp_path / "out" / "data").glob("*.parquet"))) == before and got.count() == 4


LISTING = "id string, name string, drive_path string, mimeType string, modifiedTime string, md5Checksum string, snapshot int, files long"


def test_a_listing_is_acted_on_once_it_is_whole(spark, tmp_path):
    """Three listings, the second in two pieces that arrive after the third: equal to three runs in order, and no file is taken for removed early."""
    from lectern.plans import corpus
    from lectern.plans.corpus_queries import flat, two_pages

    def rows(number, **files):
        return [(i, f"{i}.txt", None, None, "2024-02-01T10:00:00Z", v, number, len(files)) for i, v in files.items()]

    texts = {1: {"a": "one", "b": "two", "c": "three"}, 2: {"a": "one", "b": "two and more", "d": "four"}, 3: {"b": "two and more", "d": " ", "e": "broken"}}
    at = lambda n: spark.createDataFrame([(i, t.encode()) for i, t in texts[n].items()], "id string, content binary")
    snapshots = {n: rows(n, **t) for n, t in texts.items()}
    arriving = Deliveries(spark, tmp_path, LISTING)
    path, options = str(tmp_path / "out"), dict(now=F.to_timestamp(F.lit("2024-04-01 00:00:00")))

    def run():
        streams.follow_corpus(arriving.stream(), path, at, two_pages, flat, 1, parts=4, **options)
        table, manifest = streams.corpus_tables(spark, path, 4)
        if not table.exists():
            return None
        return {(r.drive_file_id, r.content) for r in table.read().collect()}, {(r.drive_file_id, r.status) for r in manifest.read().collect()}

    arriving.write(snapshots[1][:2])
    assert run() is None
    arriving.write(snapshots[1][2:])
    first = run()
    assert first == ({("a", "one"), ("b", "two"), ("c", "three")}, {(x, "active") for x in "abc"})
    arriving.write(snapshots[3])
    arriving.write(snapshots[2][:1])
    assert run() == first
    arriving.write(snapshots[2])
    last = run()
    assert last == ({("b", "two and more")}, {("b", "active"), ("d", "active"), ("e", "error")})
    assert run() == last
    # the batch twin
    table, manifest = spark.createDataFrame([], "id string, drive_file_id string, source string"), spark.createDataFrame([], streams._MANIFEST)
    for n, listed in snapshots.items():
        done = corpus.reconcile(spark.createDataFrame(listed, LISTING).drop("snapshot", "files"), manifest, at(n), table, two_pages, flat, 1, **options)
        table, manifest = (spark.createDataFrame(x.collect(), x.schema) for x in (done.table, done.manifest))
    whole = lambda df: normalized(df.drop("embedding").toPandas())
    streamed, entries = (x.read() for x in streams.corpus_tables(spark, path, 4))
    assert whole(streamed.select(sorted(set(streamed.columns) - {"embedding"}))) == whole(table.select(sorted(set(streamed.columns) - {"embedding"})))
    assert whole(entries) == whole(manifest.select(entries.columns))
