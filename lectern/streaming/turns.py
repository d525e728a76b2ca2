"""Streams of turns, session states, counts, health checks and corpus files.

Every function takes and returns streaming DataFrames, or starts a query. What is final once it is known (turns, decisions, closed
windows) is written in append mode by the file sink, which commits each micro-batch once; state ends by watermark, timer or
time to live. Only the newest checks change while a stream runs; they are written in update mode.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.base import half_up
from ..functions.identity import chunk_record_id
from ..operators.chunking import chunk_recursive
from ..operators.dedup import TURN_KEY, dedup_turns
from ..operators.flow import DECISION_SCHEMA, EVENT_COLUMNS, replay, start_of, tag_turns
from ..operators.metrics import latency_sample
from ..operators.ordering import newest_per_key
from ..plans import corpus
from ..session import exists, file_system, scratch_path, written
from ..sources.sinks import PARTS, DealtTable, write_chunks


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


# ---- unique turns


def delivered_once(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Rows of turns with a request id, each write of a turn once: deliveries that are repeated within ``delay`` go.

    The watermark follows the time of arrival, not of creation, so that no row is ever too late, and the state holds what arrived within
    the delay, however long the stream runs. A repeat after that is appended and settled on reading, like a retried write under another
    id: rows that are appended cannot be taken back."""
    keyed = messages.filter(F.col("request_id").isNotNull()).withColumn("_arrived", F.current_timestamp())
    return keyed.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark([*TURN_KEY, "id", "created_at"]).drop("_arrived")


def without_request(messages: DataFrame) -> DataFrame:
    """Rows without a request id: each is a turn of its own and stays. Stateless."""
    return messages.filter(F.col("request_id").isNull())


def run_unique_turns(messages: DataFrame, path: str, delay: str = "1 hour") -> list[dict]:
    """Append all turns of a stream of messages below ``path``; returns the progress of the stateful part."""
    progress = run_appended(delivered_once(messages, delay), f"{path}/keyed")
    run_appended(without_request(messages), f"{path}/other")
    return progress


def read_unique_turns(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``run_unique_turns`` has written so far, as ``dedup_turns`` has it: of the writes of a turn the first by (created_at, id),
    whenever they arrived."""
    written_once = read_appended(spark, f"{path}/keyed", schema).dropDuplicates([*TURN_KEY, "id", "created_at"])
    return dedup_turns(written_once).unionByName(read_appended(spark, f"{path}/other", schema))


# ---- live sessions

#: A session without turns for so long is forgotten.
STATE_LIFE_MS = 30 * 24 * 3600 * 1000
#: How long a turn waits for those before it.
WAIT_MS = 10 * 60 * 1000
#: How many waiting turns of a session are read together.
AT_ONCE = 1_000
#: How many of a session's turns in one micro-batch are sorted together.
SORTED_AT_ONCE = 5_000

_SESSION = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("state", "mode", "topic")],
    *[T.StructField(n, T.IntegerType()) for n in ("question", "attempt")],
    *[T.StructField(n, T.LongType()) for n in ("revision", "turn", "early")],
    T.StructField("missing", T.ArrayType(T.LongType())),
])
_TURN = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("intent", "inline_mode", "inline_topic", "message")],
    *[T.StructField(n, T.BooleanType()) for n in ("letter", "blank", "retry", "is_failed")],
    T.StructField("until", T.LongType()),
])
#: A decision, or (``late``) a turn that came after the session had gone on without it.
LIVE_SCHEMA = T.StructType([*DECISION_SCHEMA.fields, T.StructField("message", T.StringType()), T.StructField("late", T.BooleanType())])


_DECISION, _TURN_OF_STATE = Row(*LIVE_SCHEMA.names), Row(*_TURN.names)


class _Early:
    """The turns of one session that wait. Up to ``AT_ONCE`` are read together and only what is left of them is stored in the end; more are
    asked for one by one, so that none but these are in memory."""

    def __init__(self, state, count: int):
        self.state, self.count = state, count
        self.near: dict | None = None if count else {}  # the waiting turns, if they are in memory
        self.stored: set[int] = set()  # those of them that are in the state
        self.taken: list[int] = []  # turns that are still in the state and wait no longer
        self.apart = count > AT_ONCE
        self.put_until: int | None = None

    def _read(self) -> bool:
        """Whether the waiting turns are in memory."""
        if self.near is None and not self.apart:
            self.near = {key[0]: _TURN_OF_STATE(*value) for key, value in self.state.iterator()}
            self.stored, self.count = set(self.near), len(self.near)
        return self.near is not None

    def __contains__(self, turn: int) -> bool:
        if not self.count:
            return False
        return turn in self.near if self._read() else self.state.containsKey((turn,))

    def numbers(self) -> list[int]:
        return sorted(self.near) if self._read() else sorted(key[0] for key in self.state.keys())

    def get(self, turn: int):
        return self.near[turn] if self._read() else _TURN_OF_STATE(*self.state.getValue((turn,)))

    def put(self, turn: int, values: tuple) -> None:
        self.count, self.put_until = self.count + 1, values[-1]
        if not self._read():
            self.state.updateValue((turn,), values)
            return
        self.near[turn] = _TURN_OF_STATE(*values)
        if len(self.near) > AT_ONCE:
            self.store()
            self.near, self.apart = None, True

    def take(self, turn: int):
        found = self.get(turn)
        self.count -= 1
        if self.near is None:
            self.state.removeKey((turn,))
        else:
            del self.near[turn]
            if turn in self.stored:
                self.stored.remove(turn)
                self.taken.append(turn)
        return found

    def store(self) -> None:
        """Bring the state in step with memory."""
        if self.near is None:
            return
        if self.taken and not self.stored:
            self.state.clear()
        else:
            for turn in self.taken:
                self.state.removeKey((turn,))
        for turn in self.near.keys() - self.stored:
            self.state.updateValue((turn,), tuple(self.near[turn]))
        self.stored, self.taken = set(self.near), []


def _in_order(rows: Iterator[Row]) -> Iterator[Row]:
    """Rows sorted by turn, ``SORTED_AT_ONCE`` at a time; those without a number first."""
    while chunk := list(islice(rows, SORTED_AT_ONCE)):
        yield from sorted(chunk, key=lambda row: (row.turn is not None, row.turn or 0))


class LiveSession(StatefulProcessor):
    """The state of each session, the turns that came early, and the numbers of those that were given up.

    Sessions are many and bring few turns each, so that a session costs as few calls of the state as can be, and rows are not made into
    pandas frames of a few rows."""

    def __init__(self, wait_ms: int = WAIT_MS, life_ms: int = STATE_LIFE_MS):
        self.wait_ms, self.life_ms = wait_ms, life_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("session", _SESSION, self.life_ms)
        self.early_turns = handle.getMapState("early", "turn bigint", _TURN, self.life_ms)

    def _enter(self) -> None:
        found = self.held.get() if self.held.exists() else None
        if found is None:
            found = (None, None, None, None, None, 0, -1, 0, [])
        state, mode, self.topic, question, attempt, self.revision, self.turn, waiting, missing = found
        self.topic = self.topic or ""
        self.state, self.missing = start_of(state, mode, self.topic, question, attempt), list(missing or [])
        self.early = _Early(self.early_turns, waiting)
        self.out: list[Row] = []

    def _leave(self) -> Iterator[Row]:
        s = self.state
        self.early.store()
        self.held.update((
            s.state, s.mode, self.topic, int(s.question), int(s.attempt), self.revision, self.turn, self.early.count, self.missing))
        yield from self.out

    def _apply(self, session: str, turn: int, row) -> None:
        self.state, self.topic, self.revision, decision = replay(self.state, self.topic, self.revision, row)
        self.turn = turn
        self.out.append(_DECISION(session, turn, *decision, None, False))

    def _drain(self, session: str) -> None:
        """Apply what waited for the turn that was applied last."""
        while self.turn + 1 in self.early:
            self._apply(session, self.turn + 1, self.early.take(self.turn + 1))

    def _go_on(self, session: str, now: int) -> None:
        """Give up the turns that others have waited for long enough."""
        for first in self.early.numbers():
            if first <= self.turn:
                continue  # applied with one before it
            if self.early.get(first).until > now:
                break  # has a timer of its own
            self.missing += [self.turn + 1, first - 1]
            self.turn = first - 1
            self._drain(session)

    def _late(self, session: str, turn: int | None, row) -> None:
        self.out.append(_DECISION(session, turn, row.intent, *[None] * (len(DECISION_SCHEMA) - 3), row.message, True))

    def _given_up(self, turn: int) -> bool:
        """Whether the session went on without this turn; it is known from then on."""
        at = bisect_left(self.missing, turn)
        if at == len(self.missing) or (at % 2 == 0 and self.missing[at] != turn):
            return False
        at -= at % 2
        first, last = self.missing[at:at + 2]
        rest = [first, turn - 1] if first < turn else []
        self.missing[at:at + 2] = rest + ([turn + 1, last] if turn < last else [])
        return True

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._enter()
        now = timerValues.getCurrentProcessingTimeInMs()
        for row in _in_order(rows):
            turn = row.turn
            if turn is None or turn < 0 or (turn <= self.turn and self._given_up(turn)):
                self._late(key[0], turn, row)
            elif turn == self.turn + 1:
                self._apply(key[0], turn, row)
                self._drain(key[0])
            elif turn > self.turn and turn not in self.early:
                self.early.put(turn, (*[row[name] for name in _TURN.names[:-1]], now + self.wait_ms))
            # what is left was delivered before
        if self.early.count:
            if self.wait_ms <= 0:
                self._go_on(key[0], now)  # what is not waited for needs no state and no timer
            elif self.early.put_until is not None:
                self.handle.registerTimer(self.early.put_until)
        yield from self._leave()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._enter()
        if not self.early.count:
            return
        self._go_on(key[0], timerValues.getCurrentProcessingTimeInMs())
        yield from self._leave()

    def handleInitialState(self, key, initialState, timerValues) -> None:
        stored = initialState
        self.held.update((stored.state, stored.mode, stored.current_topic, stored.quiz_question or 0, stored.quiz_attempt or 0,
                          stored.revision or 0, -1 if stored.turn is None else stored.turn, 0, []))

    def close(self) -> None:
        pass


def live_sessions(turns: DataFrame, wait_ms: int = WAIT_MS, states: DataFrame | None = None) -> DataFrame:
    """Decisions of each turn, with the session state kept between micro-batches: the moves of ``flow.fold_turns``, in the order of the turn numbers.

    turns: session_id, turn (0, 1, 2, ... within a session), message [, answer, failed], in any order and as often as they are delivered;
    states: stored states to start from (as of ``flow.final_states``, with ``turn``, the last number that is part of them).
    A turn is decided as soon as all before it are. One that came early waits for them; after ``wait_ms`` the session goes on without
    those that are missing. A turn that comes after that is returned as a row of its own with ``late``, as are turns without a number; no row is
    lost, and repeats change nothing. A session's turns of one micro-batch are handled together, some thousands at a time."""
    tagged = tag_turns(turns).select("session_id", F.col("turn").cast("bigint").alias("turn"), *EVENT_COLUMNS)
    initial = None
    if states is not None:
        turn = F.col("turn").cast("bigint") if "turn" in states.columns else F.lit(None).cast("bigint")
        initial = states.select("session_id", "state", "mode", "current_topic", "quiz_question", "quiz_attempt", "revision", turn.alias("turn")).groupBy(
            "session_id")
    return tagged.groupBy("session_id").transformWithState(
        LiveSession(wait_ms), LIVE_SCHEMA, "Append", "ProcessingTime", initialState=initial)


def run_live_sessions(decisions: DataFrame, path: str) -> list[dict]:
    """Append decisions and late turns, each to a part of its own, so that readers of one do not touch the other."""
    return run_appended(decisions, path, partition_by=["late"])


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return _live(spark, path).filter(~F.col("late")).select(*DECISION_SCHEMA.names)


def read_late_turns(spark: SparkSession, path: str) -> DataFrame:
    """Turns that a session went on without: session_id, turn, intent, message."""
    return _live(spark, path).filter("late").select("session_id", "turn", "intent", "message")


def _live(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LIVE_SCHEMA).parquet(f"{path}/data")


# ---- activity


def windowed_activity(messages: DataFrame, delay: str = "1 day", width: str = "1 day", heartbeat: Column | None = None) -> DataFrame:
    """Messages per tumbling window, and samples and rounded mean of the total latency, once the window is closed: when a message
    came that is later than its end by ``delay``. Null times are in no window.

    ``heartbeat`` marks rows that carry nothing but the time, which a quiet source sends to let windows close."""
    beat = F.coalesce(heartbeat, F.lit(False)) if heartbeat is not None else F.lit(False)
    sample = F.when(F.col("role") == "assistant", latency_sample("total"))
    rows = messages.select("created_at", beat.alias("_beat"), sample.alias("_sample")).withWatermark("created_at", delay)
    grouped = rows.groupBy(F.window("created_at", width).alias("w")).agg(
        F.count_if(~F.col("_beat")).alias("messages"), F.count(F.when(~F.col("_beat"), F.col("_sample"))).alias("latency_samples"),
        half_up(F.coalesce(F.avg(F.when(~F.col("_beat"), F.col("_sample"))), F.lit(0.0))).alias("avg_total_ms"))
    return grouped.filter("messages > 0").select(F.col("w.start").alias("window_start"), "messages", "latency_samples", "avg_total_ms")


def run_activity(activity: DataFrame, path: str) -> int:
    """Append closed windows; returns how many rows came too late for theirs, as far as each task adds up rows of a window before it is known."""
    progress = run_appended(activity, path, idle=True)
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def newest_health(checks: DataFrame) -> DataFrame:
    """Newest check per component."""
    newest = checks.groupBy("component").agg(F.max_by(F.struct("status", "detail", "checked_at"), "checked_at").alias("c"))
    return newest.select("component", "c.*")


@contextmanager
def _settings(spark: SparkSession, idle: bool):
    """State in RocksDB, outside the heap; a micro-batch stores what it has changed there, not the whole. Without ``idle`` batches a run looks at timers with the next data only, so that it ends. The session's own
    settings are restored."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower(),
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def run_appended(stream: DataFrame, path: str, partition_by: list[str] | None = None, idle: bool = False) -> list[dict]:
    """Process what is there now and append it to the files of one table; returns the progress of the micro-batches."""
    with _settings(stream.sparkSession, idle):
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        query = (writer.partitionBy(*partition_by) if partition_by else writer).format("parquet").start(f"{path}/data")
    query.awaitTermination()
    return list(query.recentProgress)


def read_appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/data").select(*schema.names)


def run_available(stream: DataFrame, path: str, mode: str) -> None:
    """Process what is there now, for results that change: each micro-batch overwrites its own folder below ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch_id={batch_id}")

    with _settings(stream.sparkSession, False):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(
            availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def read_newest(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """State of a table written in update mode: the row of the newest batch per key."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(with_batch).parquet(f"{path}/data")
    return newest_per_key(rows, keys, [F.col("batch_id")]).select(*schema.names)


def load_corpus(files: DataFrame, path: str, size: int = 1000, overlap: int = 150, parts: int = PARTS) -> None:
    """Incremental corpus load: chunk arriving files and upsert the chunks into the table dealt by file.

    files: file_id, source, pages, and a column ``seen_at`` that rises with versions of a file. Of several versions
    in one micro-batch the newest counts; chunks that a file no longer has go, also those of a file that has become empty. A repeated
    micro-batch writes the same ids, so it changes nothing. Files that leave a listing, and the manifest, are kept by ``follow_corpus``."""

    def load(batch: DataFrame, batch_id: int) -> None:
        newest = newest_per_key(batch, ["file_id"], [F.col("seen_at")]).drop("seen_at")
        chunks = chunk_recursive(newest, size, overlap).select(
            chunk_record_id("file_id", "page_number", "chunk_index", "content_hash").alias("id"), "*")
        write_chunks(written(chunks, "chunks"), f"{path}/chunks", touched=newest.select("file_id"), key=("file_id",), parts=parts)

    files.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(
        availableNow=True).foreachBatch(load).start().awaitTermination()


def loaded_chunks(spark: SparkSession, path: str, parts: int = PARTS) -> DataFrame:
    """The chunk table of ``load_corpus``."""
    return DealtTable(spark, f"{path}/chunks", ("file_id",), parts).read()


_MANIFEST = ("drive_file_id string, name string, drive_path string, mime_type string, modified_time string, md5_checksum string, "
             "chunks_count int, status string, last_synced_at timestamp, last_error string, updated_at timestamp")


def corpus_tables(spark: SparkSession, path: str, parts: int = PARTS) -> tuple[DealtTable, DealtTable]:
    """Chunk table and manifest of ``follow_corpus``."""
    return DealtTable(spark, f"{path}/chunks", parts=parts), DealtTable(spark, f"{path}/manifest", ("drive_file_id",), parts)


def follow_corpus(listings: DataFrame, path: str, contents: Callable[[int], DataFrame | DealtTable], extractor: Callable, embed: Callable,
                  dim: int, parts: int = PARTS, **options) -> None:
    """Keep chunk table and manifest in step with a stream of listing snapshots: one run of ``reconcile`` for each.

    listings: columns of a listing, ``snapshot`` (its number: 1, 2, 3, ...) and ``files`` (how many rows it has). A snapshot may come in several
    micro-batches and rows may be repeated; it is acted on once all its files are there and those before it are done, so that what has not arrived yet is
    never taken for removed. ``contents`` gives the contents of files at the time of a snapshot. The manifest is the stored snapshot that the next one is
    compared with: files that are new, changed, gone or of an old format all follow. A run that stops anywhere is repeated as it is."""
    spark = listings.sparkSession
    table, manifest = corpus_tables(spark, path, parts)
    waiting = f"{path}/listings"

    def follow(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "snapshot", "batch").parquet(waiting)
        arrived = spark.read.parquet(waiting)
        done = spark.read.parquet(f"{path}/done").agg(F.max("snapshot")).first()[0] if exists(spark, f"{path}/done") else 0
        complete = arrived.filter(F.col("snapshot") > done).groupBy("snapshot").agg(
            (F.count_distinct("id") == F.max("files")).alias("whole")).orderBy("snapshot").collect()  # one row per open snapshot
        for number, whole in complete:
            if not whole or number != done + 1:
                break
            done = number
            listing = arrived.filter(F.col("snapshot") == number).drop("snapshot", "files", "batch").dropDuplicates(["id"])
            before = manifest.read() if manifest.exists() else spark.createDataFrame([], _MANIFEST)
            run = corpus.reconcile_into(table, listing, before, contents(number), extractor, embed, dim, **options)
            files = run.results.filter("action <> 'unchanged'").select(F.col("id").alias("drive_file_id"))
            touched = manifest.touched(files)
            manifest.replace(run.manifest.filter(manifest.part(run.manifest.columns).isin(touched)), touched)
            spark.range(1).select(F.lit(number).cast("bigint").alias("snapshot")).write.mode("append").parquet(f"{path}/done")
            fs, Path = file_system(spark, waiting)
            fs.delete(Path(f"{waiting}/snapshot={number}"), True)  # only open snapshots wait

    listings.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(
        availableNow=True).foreachBatch(follow).start().awaitTermination()


def new_stream_folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"stream-{name}")
