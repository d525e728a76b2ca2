"""Conversation rules: request validation, the session state machine, state inference and turn telemetry.

The state machine is a table of moves. Spark classifies every message with native expressions into a small
event; what remains for Python is one table lookup per turn. A session is replayed in blocks of turns: the
effect of a block on each possible entry state is found independently of the blocks before it, the effects are
chained per session, and then all blocks are replayed in parallel with their known entry states. A session of
any length therefore never sits in one task, and no block is held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.base import cut, matches, present, strip
from ..functions.identity import UUID_V1_TO_V5
from ..functions.intents import asks_retry, extract_inline, intent_of_normalized
from ..functions.text import normalize_input

FLOW_VERSION = "v1"
# States, modes and what each menu choice or request leads to.
MODES = ["livre", "resumo", "quiz", "info"]
WAITING = {
    "resumo": "RESUMO_AGUARDANDO_TEMA",
    "quiz": "QUIZ_AGUARDANDO_TEMA",
    "info": "INFORMACOES_AGUARDANDO_PERGUNTA",
}
STATES = [
    "MENU_PRINCIPAL", "LIVRE", "RESUMO_AGUARDANDO_TEMA", "RESUMO_CONCLUIDO", "QUIZ_AGUARDANDO_TEMA",
    "QUIZ_EM_ANDAMENTO", "QUIZ_SEGUNDA_TENTATIVA", "QUIZ_CONCLUIDO", "INFORMACOES_AGUARDANDO_PERGUNTA",
    "ENCERRADA",
]
STARTED = {
    "resumo": ("resumo", "RESUMO_CONCLUIDO", 0, 0),
    "quiz": ("simulado_tema", "QUIZ_EM_ANDAMENTO", 1, 1),
    "info": ("info", "INFORMACOES_AGUARDANDO_PERGUNTA", 0, 0),
}
MENU = {
    "greeting": ("greeting", "MENU_PRINCIPAL", "livre", "clear"),
    "menu_return": ("menu", "MENU_PRINCIPAL", "livre", "clear"),
    "farewell": ("farewell", "ENCERRADA", "livre", "keep"),
    "menu_resumo": ("resumo_menu", "RESUMO_AGUARDANDO_TEMA", "resumo", "clear"),
    "menu_quiz": ("quiz_menu", "QUIZ_AGUARDANDO_TEMA", "quiz", "clear"),
    "menu_info": ("info_menu", "INFORMACOES_AGUARDANDO_PERGUNTA", "info", "clear"),
}
LAST_QUESTION = 3


class State(NamedTuple):
    """State of a session; the topic itself is kept outside, only its presence matters for the moves."""

    state: str = "MENU_PRINCIPAL"
    mode: str = "livre"
    has_topic: bool = False
    question: int = 0
    attempt: int = 0


class Event(NamedTuple):
    intent: str
    inline: str | None  # mode of an inline request
    letter: bool  # the message is one of A to D
    blank: bool  # the message is empty after trimming
    retry: bool  # the answer asks for a second attempt
    failed: bool  # no context or no answer


class Move(NamedTuple):
    kind: str
    reply: str | None
    generation: str | None
    # the turn's topic and the stored topic: keep, clear, inline or message
    turn_topic: str
    topic: str
    question: int
    attempt: int
    decided: State
    final: State
    counted_decision: bool
    counted: bool


def _fast(s: State, e: Event, reply: str, to: str, mode: str, topic: str) -> Move:
    after = State(to, mode, s.has_topic and topic == "keep", 0, 0)
    return Move("fast", reply, None, topic, topic, s.question, s.attempt, after, after, True, True)


def _generate(s, e, generation, turn_topic, topic, after, asked=None, counted=True) -> Move:
    """A turn that needs an answer: a failed answer puts the session back to where it was."""
    question, attempt = asked or (s.question, s.attempt)
    if e.failed:
        return Move("generate", None, generation, turn_topic, "keep", question, attempt, after, s, counted, False)
    return Move("generate", None, generation, turn_topic, topic, question, attempt, after, after, counted, counted)


# The state, mode and generation names in the moves below are fixed values.
def _start(s: State, e: Event, mode: str, topic: str, keep_counters: bool) -> Move:
    generation, to, question, attempt = STARTED[mode]
    if mode == "quiz":
        asked = (question, attempt)
    else:
        asked = None
        if keep_counters:
            question, attempt = s.question, s.attempt
    has_topic = topic == "inline" or not e.blank
    return _generate(s, e, generation, topic, topic, State(to, mode, has_topic, question, attempt), asked)


def _answer(s: State, e: Event) -> Move:
    second = s.state == "QUIZ_SEGUNDA_TENTATIVA" or s.attempt == 2
    generation = "simulado_segunda_tentativa" if second else "simulado_respondendo"
    now, attempt = max(1, s.question), 2 if second else 1
    if e.retry and not second:
        after = s._replace(state="QUIZ_SEGUNDA_TENTATIVA", mode="quiz", question=now, attempt=2)
    elif now >= LAST_QUESTION:
        after = s._replace(state="QUIZ_CONCLUIDO", mode="quiz", question=LAST_QUESTION, attempt=attempt)
    else:
        after = s._replace(state="QUIZ_EM_ANDAMENTO", mode="quiz", question=now + 1, attempt=1)
    final, counted = (s, False) if e.failed else (after, True)
    # until the answer is judged the state stays as it is
    return Move("generate", None, generation, "keep", "keep", now, attempt, s, final, False, counted)


@lru_cache(maxsize=None)
def move(s: State, e: Event) -> Move:
    """What one turn does to a session."""
    if e.intent in MENU:
        return _fast(s, e, *MENU[e.intent])
    if e.intent == "outro_tema":
        return _fast(s, e, *MENU[f"menu_{s.mode if s.mode in ('quiz', 'info') else 'resumo'}"])
    if e.inline:
        return _start(s, e, e.inline, "inline", keep_counters=False)
    summarised = s.state == "RESUMO_CONCLUIDO" and s.has_topic
    if e.intent == "aprofundar" and not summarised:
        return _fast(s, e, *MENU["menu_resumo"])
    if e.intent in ("aprofundar", "reformular_conciso") and summarised:
        generation = "resumo_aprofundar" if e.intent == "aprofundar" else "resumo_reformular"
        return _generate(s, e, generation, "keep", "keep", s._replace(mode="resumo"))
    if s.state in ("QUIZ_EM_ANDAMENTO", "QUIZ_SEGUNDA_TENTATIVA"):
        if e.letter:
            return _answer(s, e)
        return Move("fast", "quiz_invalid", None, "keep", "keep", s.question, s.attempt, s, s, False, False)
    for mode, waiting in WAITING.items():
        if s.state == waiting:
            return _start(s, e, mode, "message", keep_counters=True)
    return _generate(s, e, "livre", "keep", "keep", s._replace(state="LIVRE", mode="livre"))


def tag_turns(turns: DataFrame) -> DataFrame:
    """Adds the event of each turn, natively. turns: session_id, turn, message [, answer, failed]."""
    if "answer" not in turns.columns:
        turns = turns.withColumn("answer", F.lit(None).cast("string"))
    if "failed" not in turns.columns:
        turns = turns.withColumn("failed", F.lit(False))
    return (
        turns.withColumn("message", strip(F.coalesce("message", F.lit(""))))
        .withColumn("_norm", normalize_input("message"))
        .withColumn("_inline", extract_inline("message", F.col("_norm")))
        .select(
            *[c for c in turns.columns if c != "message"], "message",
            intent_of_normalized(F.col("_norm")).alias("intent"),
            F.col("_inline.mode").alias("inline_mode"),
            F.col("_inline.topic").alias("inline_topic"),
            F.rlike("_norm", F.lit("^[abcd]$")).alias("letter"),
            (F.col("message") == "").alias("blank"),
            asks_retry("answer").alias("retry"),
            F.coalesce("failed", F.lit(False)).alias("is_failed"),
        )
    )


EVENT_COLUMNS = ["intent", "inline_mode", "inline_topic", "letter", "blank", "retry", "is_failed", "message"]
DECISION_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("turn", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in (
        "intent", "kind", "fast_response", "generation_mode", "topic", "state_before", "state_decided",
        "state_after", "mode", "current_topic")],
    *[T.StructField(n, T.IntegerType()) for n in (
        "quiz_question", "quiz_attempt", "question_after", "attempt_after")],
    T.StructField("revision", T.LongType()),
])


def _event(row) -> Event:
    inline = row.inline_mode if isinstance(row.inline_mode, str) else None
    return Event(row.intent, inline, bool(row.letter), bool(row.blank), bool(row.retry), bool(row.is_failed))


def _topic(action: str, current: str, row) -> str:
    return {"keep": current, "clear": "", "inline": row.inline_topic, "message": row.message}[action]


def replay(state: State, topic: str, revision: int, row) -> tuple[State, str, int, list]:
    """Apply one tagged turn; returns the new state, topic and revision, and the decision's columns."""
    m = move(state, _event(row))
    new_topic = _topic(m.topic, topic, row)
    new_revision = revision + (1 if m.counted else 0)
    decision = [
        row.intent, m.kind, m.reply, m.generation, _topic(m.turn_topic, topic, row), state.state, m.decided.state,
        m.final.state, m.final.mode, new_topic, m.question, m.attempt, m.final.question, m.final.attempt,
        new_revision,
    ]
    return m.final, new_topic, new_revision, decision


def start_of(state, mode, topic, question, attempt) -> State:
    """State from stored columns; missing ones take the defaults."""
    text = lambda v, default: v if isinstance(v, str) else default
    number = lambda v: 0 if v is None or v != v else int(v)
    return State(text(state, "MENU_PRINCIPAL"), text(mode, "livre"), bool(text(topic, "")), number(question), number(attempt))


_EFFECT = T.ArrayType(T.StructType([
    T.StructField("exit", T.StringType()), T.StructField("topic", T.StringType()), T.StructField("counted", T.LongType()),
    T.StructField("entries", T.ArrayType(T.IntegerType())),
]))
_MODE_OF_STATE = {
    "MENU_PRINCIPAL": "livre", "LIVRE": "livre", "ENCERRADA": "livre", "RESUMO_AGUARDANDO_TEMA": "resumo",
    "RESUMO_CONCLUIDO": "resumo", "QUIZ_AGUARDANDO_TEMA": "quiz", "QUIZ_EM_ANDAMENTO": "quiz",
    "QUIZ_SEGUNDA_TENTATIVA": "quiz", "QUIZ_CONCLUIDO": "quiz", "INFORMACOES_AGUARDANDO_PERGUNTA": "info",
}
# every state that moves can lead to
_EVERY_STATE = [State(s, m, *rest) for s, m in _MODE_OF_STATE.items() for rest in product((False, True), range(4), range(3))]
_NUMBER = {s: i for i, s in enumerate(_EVERY_STATE)}
# number of the one state that moves cannot lead to: the stored state of a session
_STORED = -1
_KEY = "|".join


def _pack(s: State) -> str:
    return _KEY([s.state, s.mode, str(int(s.has_topic)), str(s.question), str(s.attempt)])


def _unpack(text: str) -> State:
    state, mode, has_topic, question, attempt = text.split("|")
    return State(state, mode, has_topic == "1", int(question), int(attempt))


@lru_cache(maxsize=None)
def _from_everywhere(event: Event) -> tuple:
    """The first turn of a block from every state: (final state, topic action, counted, entry states)."""
    merged: dict = {}
    for s in _EVERY_STATE:
        m = move(s, event)
        merged.setdefault((m.final, m.topic, m.counted), []).append(s)
    return tuple((*k, tuple(v)) for k, v in merged.items())


def _block_effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per (session, block) of sorted rows: exit state, topic (null = kept) and count for every entry state.

    The entry states are all that moves can lead to, and the one the session is stored with."""
    at, images = None, {}

    def done():
        effect = [
            {"exit": _pack(s), "topic": topic, "counted": n, "entries": [_NUMBER.get(e, _STORED) for e in entries]}
            for (s, topic, n), entries in images.items()
        ]
        return pd.DataFrame({"session_id": [at[0]], "block": [at[1]], "effect": [effect]})

    def put(into: dict, final: State, topic: str | None, count: int, entries) -> None:
        into.setdefault((final, topic, count), []).extend(entries)

    for batch in batches:
        for row in batch.itertuples(index=False):
            event, merged = _event(row), {}
            if (row.session_id, row.block) != at:
                if at is not None:
                    yield done()
                at = (row.session_id, row.block)
                for final, action, counted, entries in _from_everywhere(event):
                    put(merged, final, None if action == "keep" else _topic(action, "", row), int(counted), entries)
                stored = start_of(row.state0, row.mode0, row.topic0, row.question0, row.attempt0)
                if stored not in _NUMBER:
                    m = move(stored, event)
                    put(merged, m.final, None if m.topic == "keep" else _topic(m.topic, "", row), int(m.counted), [stored])
            else:
                # entries that reached the same point share one image from there on
                for (s, topic, n), entries in images.items():
                    m = move(s, event)
                    put(merged, m.final, topic if m.topic == "keep" else _topic(m.topic, "", row), n + int(m.counted), entries)
            images = merged
    if at is not None:
        yield done()


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entry state of every block of a session from the effects of the blocks before it."""
    session, state, topic, revision = None, State(), "", 0
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.session_id != session:
                session = row.session_id
                state = start_of(row.state0, row.mode0, row.topic0, row.question0, row.attempt0)
                topic = row.topic0 if isinstance(row.topic0, str) else ""
                revision = 0 if row.revision0 is None or row.revision0 != row.revision0 else int(row.revision0)
            out.append((session, row.block, state.state, state.mode, topic, state.question, state.attempt, revision))
            wanted = _NUMBER.get(state, _STORED)
            hit = next(e for e in row.effect if wanted in e["entries"])
            state, revision = _unpack(hit["exit"]), revision + int(hit["counted"])
            topic = topic if hit["topic"] is None else hit["topic"]
        yield pd.DataFrame(out, columns=["session_id", "block", "state0", "mode0", "topic0", "question0", "attempt0", "revision0"])


def _replay_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, state, topic, revision = None, State(), "", 0
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if (row.session_id, row.block) != at:
                at = (row.session_id, row.block)
                state = start_of(row.state0, row.mode0, row.topic0, row.question0, row.attempt0)
                topic = row.topic0 if isinstance(row.topic0, str) else ""
                revision = 0 if row.revision0 is None or row.revision0 != row.revision0 else int(row.revision0)
            state, topic, revision, decision = replay(state, topic, revision, row)
            out.append([row.session_id, row.turn, *decision])
        frame = pd.DataFrame(out, columns=DECISION_SCHEMA.names)
        yield frame.astype({"turn": "int64"}) if len(frame) else frame


_ENTRY = {"state0": "string", "mode0": "string", "topic0": "string", "question0": "int", "attempt0": "int", "revision0": "bigint"}


def fold_turns(turns: DataFrame, states: DataFrame | None = None, block_turns: int = 5_000) -> DataFrame:
    """Replay all sessions: one decision row per turn.

    turns: session_id, turn (dense numbers, total order within the session), message [, answer, failed];
    states: stored session states to start from (default: a new session)."""
    placed = turns.withColumn("turn", F.col("turn").cast("bigint")).withColumn("block", F.floor(F.col("turn") / block_turns))
    if states is None:
        initial = lambda df: df.select("*", *[F.lit(None).cast(t).alias(n) for n, t in _ENTRY.items()])
    else:
        start = states.select(
            "session_id", F.col("state").alias("state0"), F.col("mode").alias("mode0"), F.col("current_topic").alias("topic0"),
            F.col("quiz_question").cast("int").alias("question0"), F.col("quiz_attempt").cast("int").alias("attempt0"),
            F.col("revision").cast("bigint").alias("revision0"))
        initial = lambda df: df.join(start, "session_id", "left")

    # sessions of several blocks are set apart before the messages are classified
    span = placed.groupBy("session_id").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    long = span.filter("last > first").select("session_id")
    tagged = lambda rows: tag_turns(rows).select("session_id", "turn", *EVENT_COLUMNS, "block")
    single = tagged(placed.join(long, "session_id", "left_anti"))
    several = tagged(placed.join(long, "session_id", "left_semi"))

    def in_order(df, keys, order):
        return df.repartition(*keys).sortWithinPartitions(*keys, *order)

    effects = in_order(initial(several), ["session_id", "block"], ["turn"]).mapInPandas(
        _block_effects, T.StructType([
            T.StructField("session_id", T.StringType()), T.StructField("block", T.LongType()), T.StructField("effect", _EFFECT)]))
    entries = in_order(initial(effects), ["session_id"], ["block"]).mapInPandas(
        _chain, "session_id string, block bigint, state0 string, mode0 string, topic0 string, question0 int, "
                "attempt0 int, revision0 bigint")
    ready = initial(single).unionByName(several.join(entries, ["session_id", "block"]))
    return in_order(ready, ["session_id", "block"], ["turn"]).mapInPandas(_replay_blocks, DECISION_SCHEMA)


def latest_state(states: DataFrame) -> DataFrame:
    """Stored session states, one per session: the highest revision wins."""
    rest = [c for c in states.columns if c != "session_id"]
    return states.groupBy("session_id").agg(
        F.max_by(F.struct(*rest), F.struct("revision", "updated_at")).alias("_s")).select("session_id", "_s.*")


def final_states(decisions: DataFrame) -> DataFrame:
    """Session state after the last turn of each session."""
    last = F.struct("state_after", "mode", "current_topic", "question_after", "attempt_after", "revision")
    return decisions.groupBy("session_id").agg(F.max_by(last, "turn").alias("_s")).select(
        "session_id", F.col("_s.state_after").alias("state"), F.col("_s.mode").alias("mode"),
        F.col("_s.current_topic").alias("current_topic"), F.col("_s.question_after").alias("quiz_question"),
        F.col("_s.attempt_after").alias("quiz_attempt"), F.lit(FLOW_VERSION).alias("flow_version"),
        F.col("_s.revision").alias("revision"))


# Accepted session ids and message lengths.
SESSION_ID = "^[A-Za-z0-9._:-]{1,128}$"


def validate_requests(requests: DataFrame, shortest: int = 1, longest: int = 8000) -> DataFrame:
    """Adds trimmed ``session_id`` and ``message`` and ``error_code`` (INVALID_REQUEST or null)."""
    out = requests.withColumn("session_id", strip(F.coalesce("session_id", F.lit("")))).withColumn(
        "message", strip(F.coalesce("message", F.lit(""))))
    given = present("request_id").isNotNull()
    bad = (
        (given & ~matches("request_id", UUID_V1_TO_V5))
        | ~matches("session_id", SESSION_ID)
        | ~F.length("message").between(shortest, longest)
    )
    return out.withColumn("error_code", F.when(bad, F.lit("INVALID_REQUEST")))


# Messages that are no topic, and the opening of an inline request to cut off.
NOT_A_TOPIC = (
    "^(?:[a-d]|menu|voltar|in[ií]cio|resumo|simulado|quiz|informa[cç][oõ]es|encerrar|aprofundar|oi|ol[aá]|"
    "seja mais concis[oa]|mais concis[oa]|resuma mais|resuma isso|simplifique|resposta mais curta)$"
)
TOPIC_PREFIX = (
    "^(?:(?:quero|queria)\\s+(?:um\\s+)?|fazer\\s+)?(?:resumo(?:\\s+de\\s+conte[uú]do)?|"
    "quiz(?:\\s+da\\s+disciplina)?|simulado(?:\\s+de\\s+prova)?|op[cç][aã]o\\s+[12]|[12])\\s*"
    "(?:sobre|de|da|do|com|-|:)?\\s*"
)


def topic_of(message: Column | str) -> Column:
    """Topic a user message names, null when it names none."""
    text = strip(message)
    topic = strip(F.regexp_replace(text, "(?iu)" + TOPIC_PREFIX, ""))
    return F.when(~matches(text, "(?iu)" + NOT_A_TOPIC), present(topic))


def last_topic(history: DataFrame) -> DataFrame:
    """Newest topic named by the user in each session, '' if none. history: session_id, turn, role, content."""
    topic = F.when(F.col("role") == "user", topic_of("content"))
    return history.groupBy("session_id").agg(
        F.coalesce(F.max_by(topic, F.when(topic.isNotNull(), F.col("turn"))), F.lit("")).alias("topic"))


# Phrases of the last answer that tell the state a session is in, in order of precedence.
STATE_PHRASES = {
    "RESUMO_AGUARDANDO_TEMA": "qual tema.*(resumo|estudar)|qual tema da disciplina",
    "QUIZ_AGUARDANDO_TEMA": "qual tema.*(quiz|simulado)|farei tr[eê]s perguntas",
    "QUIZ_SEGUNDA_TENTATIVA": "resposta est[aá] incorreta.{0,80}tente novamente",
    "QUIZ_EM_ANDAMENTO": "quest[aã]o\\s*([123])",
    "RESUMO_CONCLUIDO": "deseja aprofundar este tema|deseja aprofundar mais",
    "INFORMACOES_AGUARDANDO_PERGUNTA": "deseja fazer outra pergunta|informa[cç][oõ]es da disciplina",
}
_MODE_OF = {
    "RESUMO_AGUARDANDO_TEMA": "resumo", "RESUMO_CONCLUIDO": "resumo", "QUIZ_AGUARDANDO_TEMA": "quiz",
    "QUIZ_SEGUNDA_TENTATIVA": "quiz", "QUIZ_EM_ANDAMENTO": "quiz", "INFORMACOES_AGUARDANDO_PERGUNTA": "info",
}


def infer_state(history: DataFrame) -> DataFrame:
    """Session state rebuilt from its messages. history: session_id, turn, role, content."""
    number = F.regexp_extract("content", "(?iu)quest[aã]o\\s*([123])", 1)
    spoken = F.col("role") == "assistant"
    topic = F.when(F.col("role") == "user", topic_of("content"))
    mention = F.when(spoken & (number != ""), number.cast("int"))
    seen = history.groupBy("session_id").agg(
        F.coalesce(F.max_by("content", F.when(spoken, F.col("turn"))), F.lit("")).alias("last"),
        F.coalesce(F.max_by(mention, F.when(mention.isNotNull(), F.col("turn"))), F.lit(1)).alias("asked"),
        F.coalesce(F.max_by(topic, F.when(topic.isNotNull(), F.col("turn"))), F.lit("")).alias("topic"),
    )
    state, mode = None, None
    for name, phrase in STATE_PHRASES.items():
        hit = matches("last", "(?isu)" + phrase)
        state = F.when(hit, name) if state is None else state.when(hit, name)
    state = state.otherwise("MENU_PRINCIPAL")
    out = seen.withColumn("state", state)
    for name, value in _MODE_OF.items():
        hit = F.col("state") == name
        mode = F.when(hit, value) if mode is None else mode.when(hit, value)
    waiting = F.col("state").isin("RESUMO_AGUARDANDO_TEMA", "QUIZ_AGUARDANDO_TEMA", "MENU_PRINCIPAL")
    asked_now = F.regexp_extract("last", "(?iu)quest[aã]o\\s*([123])", 1)
    return out.select(
        "session_id", "state", mode.otherwise("livre").alias("mode"),
        F.when(waiting, F.lit("")).otherwise(F.col("topic")).alias("current_topic"),
        F.when(F.col("state") == "QUIZ_SEGUNDA_TENTATIVA", F.col("asked"))
        .when(F.col("state") == "QUIZ_EM_ANDAMENTO", F.try_to_number(asked_now, F.lit("9")).cast("int"))
        .otherwise(0).alias("quiz_question"),
        F.when(F.col("state") == "QUIZ_SEGUNDA_TENTATIVA", 2).when(F.col("state") == "QUIZ_EM_ANDAMENTO", 1)
        .otherwise(0).alias("quiz_attempt"),
    )


def turn_error_code(generation_error, embedding_failed, retrieval_failed, docs) -> Column:
    """Generation error first, else why the search gave nothing."""
    search = (
        F.when(embedding_failed, F.lit("EMBEDDING_FAILED"))
        .when(retrieval_failed, F.lit("RETRIEVAL_FAILED"))
        .when(docs == 0, F.lit("NO_RELEVANT_CONTEXT"))
    )
    return F.coalesce(generation_error, search)


def search_failures(search_failed: Column, embedding_latency: Column) -> tuple[Column, Column]:
    """(embedding failed, retrieval failed): a failure before the embedding took any time is the embedding's."""
    failed = F.coalesce(search_failed, F.lit(False))
    at_embedding = failed & (F.coalesce(embedding_latency, F.lit(0)) == 0)
    return at_embedding, failed & ~at_embedding


def turn_metadata(turns: DataFrame, prompt_version: str, embedding_model: str) -> DataFrame:
    """Adds the telemetry struct of each turn.

    Navigation turns (kind = fast) have no documents, so they record has_context = false and zero stages."""
    retrieval = F.coalesce(
        "retrieval", F.array().cast("array<struct<document_id:string,source:string,rank:int,similarity:double>>"))
    fast = F.col("kind") == "fast"
    docs = F.when(fast, F.slice(retrieval, 1, 0)).otherwise(retrieval)
    stage = lambda name: F.when(fast, F.lit(0.0)).otherwise(F.coalesce(F.col(name), F.lit(0.0)))
    answered = lambda name: F.when(~fast, F.col(name))
    return turns.withColumn("metadata", F.struct(
        F.col("request_id"), F.lit(FLOW_VERSION).alias("flow_version"), F.lit(prompt_version).alias("prompt_version"),
        F.col("mode"), F.col("state_before"), F.col("state_after"), F.col("topic").alias("current_topic"),
        F.col("question_after").alias("quiz_question"), F.col("attempt_after").alias("quiz_attempt"),
        answered("model_requested").alias("model_requested"), answered("model_used").alias("model_used"),
        F.when(fast, F.lit(False)).otherwise(F.coalesce("fallback_used", F.lit(False))).alias("fallback_used"),
        answered("fallback_reason").alias("fallback_reason"),
        F.when(F.size(docs) > 0, F.lit(embedding_model)).alias("embedding_model"),
        (F.size(docs) > 0).alias("has_context"), F.size(docs).alias("sources_found"), docs.alias("retrieval"),
        F.struct(
            stage("embedding_ms").alias("embedding"), stage("retrieval_ms").alias("retrieval"),
            stage("generation_ms").alias("generation"), F.coalesce("total_ms", F.lit(0.0)).alias("total"),
        ).alias("latency_ms"),
        answered("error_code").alias("error_code"),
    ))
