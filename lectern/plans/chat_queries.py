"""Queries over conversation rules, sessions, feedback and answer quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intents
from ..functions.text import normalize_input
from ..operators import flow, quality, sessions
from .chat_sql import INTENT_SQL, SPACES, inline_sql, norm_sql, quoted
from .fold_check import FINAL, RESOLVED, STEPS
from .registry import at, query

UUID_RE = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
V15_RE = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
# ---- H: conversation rules

REQUESTS = """, requests as (select h, case h % 7 when 0 then ' ' || session_id || ' ' when 1 then 'não vale' when 2 then null else session_id end as session_id,
  case when h % 5 = 0 then 'no-uuid' when h % 5 = 1 then '' else request_id end as request_id, case when h % 11 = 0 then '  ' else ' ' || repeat(content, 1 + h % 60) end as message from messages)"""


@query("h1_validate_requests", "messages", REQUESTS + f"""
, trimmed as (select h, trim(coalesce(session_id, ''), {SPACES}) as session_id, request_id, trim(coalesce(message, ''), {SPACES}) as message from requests)
select h, session_id, md5(message) as message_md5, case when (request_id <> '' and not regexp_matches(request_id, '{V15_RE}'))
  or not regexp_matches(session_id, '^[A-Za-z0-9._:-]{{1,128}}$') or length(message) not between 1 and 8000 then 'INVALID_REQUEST' end as error_code from trimmed""")
def _(t):
    m, h = t.messages, F.col("h")
    requests = m.select(
        "h",
        F.when(h % 7 == 0, F.concat(F.lit(" "), "session_id", F.lit(" "))).when(h % 7 == 1, F.lit("não vale"))
        .when(h % 7 != 2, F.col("session_id")).alias("session_id"),
        F.when(h % 5 == 0, F.lit("no-uuid")).when(h % 5 == 1, F.lit("")).otherwise(F.col("request_id")).alias("request_id"),
        F.when(h % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.expr("repeat(content, cast(1 + h % 60 as int))"))).alias("message"))
    return flow.validate_requests(requests).select("h", "session_id", F.md5("message").alias("message_md5"), "error_code")


@query("h2_normalize_input", "", f"select doc_id, md5({norm_sql('text')}) as normalized_md5 from documents")
def _(t):
    return t.given("documents").select("doc_id", F.md5(normalize_input("text")).alias("normalized_md5"))


@query("h3_detect_intent", "dialog", f"select session_id, turn, {INTENT_SQL} as intent from (select *, {norm_sql('content')} as n from dialog)")
def _(t):
    return t.dialog.select("session_id", "turn", intents.detect_intent("content").alias("intent"))


LEGACY_NORM = f"regexp_replace(trim(lower(regexp_replace(strip_accents(content), '[^\\x00-\\x7F]', '', 'g')), {SPACES}), '[^a-z0-9_\\s]', ' ', 'g')"


@query("h4_legacy_intents", "dialog", f"""
select session_id, turn, {' or '.join(f"contains(n, '{w}')" for w in intents.LEGACY_END_WORDS)} as is_end,
  {' or '.join(f"contains(n, '{w}')" for w in intents.LEGACY_MENU_WORDS)} as is_menu,
  len(w) > 0 and len(list_filter(w, lambda x: x not in ({quoted(intents.LEGACY_COURTESY_WORDS)}))) = 0 as is_courtesy
from (select *, list_filter(regexp_split_to_array(n, '\\s+'), lambda x: x <> '') as w from (select *, {LEGACY_NORM} as n from dialog))""")
def _(t):
    return t.dialog.select("session_id", "turn", intents.legacy_intents("content").alias("i")).select("session_id", "turn", "i.*")


@query("h5_extract_inline", "dialog", f"""
select session_id, turn, case when q is not null then 'quiz' when r is not null then 'resumo' when i is not null then 'info' end as mode,
  md5(coalesce(q, r, i)) as topic_md5 from (select *, {inline_sql('quiz')} as q, {inline_sql('resumo')} as r, {inline_sql('info')} as i
  from (select *, {norm_sql('content')} as n from dialog))""")
def _(t):
    return t.dialog.select("session_id", "turn", intents.extract_inline("content").alias("i")).select(
        "session_id", "turn", "i.mode", F.md5("i.topic").alias("topic_md5"))


def exchanges(t):
    """Dialogue turns with the message of the user and the answer that follows it."""
    users = t.dialog.filter("role = 'user'").select("session_id", "turn", F.col("content").alias("message"), "h")
    answers = t.dialog.filter("role = 'assistant'").select(
        "session_id", (F.col("turn") - 1).alias("turn"), F.col("content").alias("answer"))
    return users.join(answers, ["session_id", "turn"], "left").withColumn("failed", F.col("h") % 10 == 0)


@query("h6_resolve_turn", "dialog", RESOLVED)
def _(t):
    return flow.fold_turns(exchanges(t)).select(
        "session_id", "turn", "intent", "kind", "fast_response", "generation_mode", "topic", "state_before", "state_decided",
        "quiz_question", "quiz_attempt")


@query("h6_resolve_turn_in_blocks", "dialog", STEPS)
def _(t):
    return flow.fold_turns(exchanges(t), block_turns=2).select("session_id", "turn", "state_before", "state_after", "current_topic", "revision")


@query("h7_finalize_turn", "dialog", FINAL)
def _(t):
    return flow.final_states(flow.fold_turns(exchanges(t)))


def history_sql(phrase: str) -> str:
    return f"regexp_matches(last, '(?is){phrase}')"


STATE_SQL = "case " + " ".join(f"when {history_sql(p)} then '{s}'" for s, p in flow.STATE_PHRASES.items()) + " else 'MENU_PRINCIPAL' end"
TOPIC_SQL = (f"case when not regexp_matches(trim(content, {SPACES}), '(?i){flow.NOT_A_TOPIC}') then "
             f"nullif(trim(regexp_replace(trim(content, {SPACES}), '(?i){flow.TOPIC_PREFIX}', ''), {SPACES}), '') end")


@query("h8_infer_state", "dialog", f"""
, seen as (select session_id, coalesce(arg_max(content, turn) filter (where role = 'assistant'), '') as last,
    coalesce(arg_max(nullif(regexp_extract(content, '(?i)quest[aã]o\\s*([123])', 1), ''), turn) filter (where role = 'assistant' and regexp_extract(content, '(?i)quest[aã]o\\s*([123])', 1) <> ''), '1') as asked,
    coalesce(arg_max({TOPIC_SQL}, turn) filter (where role = 'user' and {TOPIC_SQL} is not null), '') as topic from dialog group by session_id)
, named as (select *, {STATE_SQL} as state from seen)
select session_id, state, case when state like 'RESUMO%' then 'resumo' when state like 'QUIZ%' then 'quiz' when state like 'INFO%' then 'info' else 'livre' end as mode,
  case when state in ('RESUMO_AGUARDANDO_TEMA', 'QUIZ_AGUARDANDO_TEMA', 'MENU_PRINCIPAL') then '' else topic end as current_topic,
  cast(case state when 'QUIZ_SEGUNDA_TENTATIVA' then asked when 'QUIZ_EM_ANDAMENTO' then regexp_extract(last, '(?i)quest[aã]o\\s*([123])', 1) else '0' end as int) as quiz_question,
  case state when 'QUIZ_SEGUNDA_TENTATIVA' then 2 when 'QUIZ_EM_ANDAMENTO' then 1 else 0 end as quiz_attempt from named""")
def _(t):
    return flow.infer_state(t.dialog)


@query("h9_last_topic", "dialog", f"""
select session_id, coalesce(arg_max({TOPIC_SQL}, turn) filter (where role = 'user' and {TOPIC_SQL} is not null), '') as topic from dialog group by session_id""")
def _(t):
    return flow.last_topic(t.dialog)


ANSWERING = "case h % 3 when 0 then 'simulado_respondendo' when 1 then 'simulado_segunda_tentativa' else 'livre' end"


@query("h10_next_question_missing", "dialog", f"""
select session_id, turn, {ANSWERING} <> 'livre' and greatest(1, h % 4) < 3 and not regexp_matches(content, '(?is)resposta est[aá] incorreta.{{0,80}}tente novamente')
  and not regexp_matches(content, '(?i)quest[aã]o\\s*' || (greatest(1, h % 4) + 1) || '\\s*:') as missing from dialog""")
def _(t):
    return t.dialog.select("session_id", "turn", intents.next_question_missing(F.expr(ANSWERING), F.col("h") % 4, F.col("content")).alias("missing"))


KIND_MODES = "case h % 9 when 0 then 'resumo' when 1 then 'resumo_aprofundar' when 2 then 'resumo_reformular' when 3 then 'info' when 4 then 'simulado_tema' when 5 then 'simulado_respondendo' when 6 then 'simulado_segunda_tentativa' else 'livre' end"


@query("h11_response_kind", "dialog", f"""
select session_id, turn, case when h % 6 = 0 then 'navigation' when h % 7 = 0 then 'fallback' when m like 'resumo%' then 'summary' when m = 'info' then 'info'
  when m = 'simulado_tema' then 'quiz_question' when m like 'simulado%' then case when regexp_matches(content, '(?i)quest[aã]o\\s*[0-9]+\\s*:') then 'quiz_question' else 'quiz_feedback' end
  else 'free' end as kind from (select *, {KIND_MODES} as m from dialog)""")
def _(t):
    kind = F.when(F.col("h") % 6 == 0, "fast").otherwise("generate")
    return t.dialog.select("session_id", "turn", intents.response_kind(kind, F.col("h") % 7 == 0, F.expr(KIND_MODES), F.col("content")).alias("kind"))


@query("h12_turn_metadata", "turns", """
select id, mode, case when f then 0 else coalesce(sources_found, 0) end as sources_found, not f and coalesce(sources_found, 0) > 0 as has_context,
  case when not f and coalesce(sources_found, 0) > 0 then 'embed-1' end as embedding_model, not f and coalesce(fallback_used, false) as fallback_used,
  case when not f then fallback_reason end as fallback_reason, case when not f then model_used end as model_used,
  case when f then 0 else coalesce(lat_embedding, 0) end as embedding, coalesce(lat_total, 0) as total, case when not f then error_code end as error_code
from (select *, event_id % 4 = 0 as f from turns)""")
def _(t):
    flat = t.telemetry()
    turns = flat.select(
        "id", "request_id", F.when(F.col("event_id") % 4 == 0, "fast").otherwise("generate").alias("kind"), "metadata.mode", "metadata.state_before",
        "metadata.state_after", F.col("metadata.current_topic").alias("topic"), F.lit(1).alias("question_after"), F.lit(1).alias("attempt_after"),
        "metadata.model_used", F.col("metadata.model_used").alias("model_requested"), "metadata.fallback_used", "metadata.fallback_reason", "metadata.retrieval",
        F.col("metadata.latency_ms.embedding").alias("embedding_ms"), F.col("metadata.latency_ms.retrieval").alias("retrieval_ms"),
        F.col("metadata.latency_ms.generation").alias("generation_ms"), F.col("metadata.latency_ms.total").alias("total_ms"), "metadata.error_code")
    built = flow.turn_metadata(turns, "p1", "embed-1")
    return built.select("id", "metadata.mode", "metadata.sources_found", "metadata.has_context", "metadata.embedding_model", "metadata.fallback_used",
                        "metadata.fallback_reason", "metadata.model_used", "metadata.latency_ms.embedding", "metadata.latency_ms.total", "metadata.error_code")


@query("h13_turn_error_code", "turns", """
select id, coalesce(case when event_id % 6 = 0 then 'MODEL_FAILED' end, case when event_id % 4 = 1 and event_id % 3 = 0 then 'EMBEDDING_FAILED'
  when event_id % 4 = 1 then 'RETRIEVAL_FAILED' when coalesce(sources_found, 0) = 0 then 'NO_RELEVANT_CONTEXT' end) as code from turns""")
def _(t):
    e = F.col("event_id")
    embedding, search = flow.search_failures(e % 4 == 1, F.when(e % 3 == 0, F.lit(0)).otherwise(F.lit(12)))
    code = flow.turn_error_code(F.when(e % 6 == 0, F.lit("MODEL_FAILED")), embedding, search, F.coalesce("sources_found", F.lit(0)))
    return t.turns.select("id", code.alias("code"))


@query("h14_invalid_transitions", "turns", """
select id, state_before, previous_state from (
  select *, lag(state_after) over (partition by session_id order by created_at, id) as previous_state from turns where has_meta)
where previous_state is not null and state_before is not null and state_before <> previous_state""")
def _(t):
    return flow_invalid(t)


def flow_invalid(t):
    rows = t.telemetry().filter("metadata is not null").select(
        "id", "session_id", "created_at", "metadata.state_before", "metadata.state_after")
    return sessions.invalid_transitions(rows).select("id", "state_before", "previous_state")


# ---- J: sessions and turns

@query("j1_recent_history", "messages", """
select session_id, id, role, cast(position as int) as position from (
  select *, row_number() over (partition by session_id order by created_at desc, id desc) as position from messages)
where position <= 4 and role in ('user', 'assistant')""")
def _(t):
    return sessions.recent_history(t.messages, 4).select("session_id", "id", "role", "position")


@query("j2_session_history", "messages", """
select session_id, id, cast(position as int) as position from (
  select *, row_number() over (partition by session_id order by created_at, id) as position from messages) where position <= 3""")
def _(t):
    return sessions.session_history(t.messages, 3).select("session_id", "id", "position")


@query("j3_find_completed_turn", "messages", """
select session_id, request_id, md5(content) as content_md5 from messages
where role = 'assistant' and request_id in (select request_id from messages where role = 'user' and request_id is not null)""")
def _(t):
    requests = t.messages.filter("role = 'user' and request_id is not null")
    return sessions.find_completed_turns(requests, t.chat()).select("session_id", "request_id", F.md5("content").alias("content_md5"))


@query("j4_session_summary", "messages known_sessions", f"""
select s.id as session_id, {at('s.created_at')} as session_started_at, {at('s.updated_at')} as session_last_activity, count(m.id) as total_messages,
  count(m.id) filter (where m.role = 'user') as user_messages, count(m.id) filter (where m.role = 'assistant') as ai_messages, {at('max(m.created_at)')} as last_message_at
from known_sessions s left join messages m on m.session_id = s.id group by all""")
def _(t):
    return sessions.session_summary(t.known_sessions, t.messages)


@query("j5_orphan_sessions", "messages known_sessions", f"""
select session_id, count(*) as message_count, {at('min(created_at)')} as first_message_at, {at('max(created_at)')} as last_message_at from messages
where session_id not in (select id from known_sessions) group by session_id order by max(created_at) desc, session_id limit 50""")
def _(t):
    return sessions.orphan_sessions(t.messages, t.known_sessions)


@query("j6_message_audit", "messages", f"""
select count(*) as total_messages, count(distinct session_id) as total_sessions, count(*) filter (where role = 'assistant') as assistant_messages,
  count(*) filter (where role = 'assistant' and has_meta) as assistant_messages_with_metadata, {at('min(created_at)')} as first_message_at, {at('max(created_at)')} as last_message_at from messages""")
def _(t):
    return sessions.message_audit(t.chat())


@query("j7_chunk_audit", "chunks", """
select count(*) as total_chunks, count(distinct source) as total_sources, count(drive_file_id) as chunks_with_drive_file_id,
  count(distinct drive_file_id) as distinct_drive_file_ids, count(content_hash) as chunks_with_content_hash from chunks""")
def _(t):
    return sessions.chunk_audit(t.chunks)


@query("j9_pair_turns", "messages", """
select session_id, request_id, md5(q) as question_md5, md5(a) as answer_md5, case when a is null then 'ASSISTANT_TURN_NOT_FOUND' when q is null then 'USER_TURN_NOT_FOUND' end as error from (
  select session_id, request_id, max(content) filter (where role = 'user') as q, max(content) filter (where role = 'assistant') as a
  from messages where request_id is not null and role in ('user', 'assistant') group by session_id, request_id)""")
def _(t):
    return sessions.pair_turns(t.messages).select(
        "session_id", "request_id", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"), "error")


@query("j10_role_map", "messages", "select id, case role when 'user' then 'human' when 'assistant' then 'ai' else role end as legacy_role, role from messages")
def _(t):
    legacy = t.messages.select("id", sessions.role_map(F.col("role")).alias("legacy_role"))
    return legacy.withColumn("role", sessions.role_map(F.col("legacy_role"), to_legacy=False))


@query("j11_latest_state", "turns", """
select session_id, state_after as state, event_id as revision from (
  select *, row_number() over (partition by session_id order by event_id desc) as rn from turns) where rn = 1""")
def _(t):
    states = t.turns.select("session_id", F.col("state_after").alias("state"), F.col("event_id").alias("revision"), F.col("created_at").alias("updated_at"))
    return flow.latest_state(states).select("session_id", "state", "revision")


@query("j12_session_id_kinds", "messages", f"""
select case when regexp_matches(session_id, '{UUID_RE}') then 'uuid' else 'legacy' end as kind, count(distinct session_id) as sessions, count(*) as messages from messages group by 1""")
def _(t):
    return sessions.session_id_kinds(t.messages)


# ---- L: feedback

CLEAN = f""", cleaned as (select coalesce(nullif(substr(trim(session_id), 1, 128), ''), 'anonymous') as session_id,
    case when regexp_matches(request_id, '{V15_RE}') then request_id end as request_id, cast(try_cast(trim(rating) as double) as int) as rating, created_at
  from feedback_raw where try_cast(trim(rating) as double) = floor(try_cast(trim(rating) as double)) and try_cast(trim(rating) as double) between 1 and 5)"""
KEPT = CLEAN + """, kept as (select session_id, request_id, rating, created_at from (
    select *, row_number() over (partition by session_id, request_id order by created_at desc, rating desc) as rn from cleaned) where rn = 1 or request_id is null)"""


def kept(t):
    return quality.upsert_feedback(quality.clean_feedback(t.feedback()))


@query("l1_clean_feedback", "feedback_raw", CLEAN + f"select session_id, request_id, rating, {at('created_at')} as created_at from cleaned")
def _(t):
    return quality.clean_feedback(t.feedback())


@query("l2_upsert_feedback", "feedback_raw", KEPT + f"select session_id, request_id, rating, {at('created_at')} as created_at from kept")
def _(t):
    return kept(t)


@query("l3_session_rating", "turns feedback_raw", KEPT + """
select s.session_id, r.avg_rating, coalesce(r.n, 0) as rating_count from (select distinct session_id from turns) s
left join (select session_id, round(avg(rating), 1) as avg_rating, count(*) as n from kept group by session_id) r on r.session_id = s.session_id""")
def _(t):
    return quality.session_rating(t.turns.select("session_id").distinct(), kept(t))


@query("l4_rating_stats", "feedback_raw", KEPT + """
select count(*) filter (where rating = 5) as stars_5, count(*) filter (where rating = 4) as stars_4, count(*) filter (where rating = 3) as stars_3,
  count(*) filter (where rating = 2) as stars_2, count(*) filter (where rating = 1) as stars_1, count(*) as total_feedbacks,
  round(sum(rating) / count(*), 1) as avg_rating, cast(round(100.0 * count(*) filter (where rating >= 4) / count(*)) as bigint) as satisfaction_rate from kept""")
def _(t):
    return quality.rating_stats(kept(t))


@query("l5_rating_by_mode", "turns feedback_raw", KEPT + """
select coalesce(mode, 'none') as mode, count(*) as ratings, round(avg(rating), 2) as avg_rating,
  cast(round(100.0 * count(*) filter (where rating >= 4) / count(*)) as bigint) as satisfaction_rate
from kept k join turns t on t.session_id = k.session_id and t.request_id = k.request_id group by 1""")
def _(t):
    return quality.rating_by_mode(kept(t), t.telemetry())


# ---- M: automatic evaluation

CONTEXT = """, context as (select h.session_id, h.request_id, h.rank, c.source, c.content from hits h join chunks c on c.id = h.document_id
    where h.request_id is not null and h.document_id <> '' and h.document_id not like 'source:%')"""


def context(t, max_chars=None):
    turns = t.telemetry().filter("request_id is not null and metadata is not null").select("session_id", "request_id", "metadata.retrieval")
    return quality.eval_context(turns, t.chunks, max_chars)


@query("m1_eval_context", "turns hits chunks", CONTEXT + "select session_id, request_id, cast(rank - 1 as int) as pos, source, md5(content) as content_md5 from context")
def _(t):
    return context(t).select("session_id", "request_id", "pos", "source", F.md5("content").alias("content_md5"))


@query("m2_eval_material", "turns hits chunks", CONTEXT + """
select session_id, request_id, count(*) as source_count, md5(string_agg('[Fonte: ' || source || ']' || chr(10) || substr(content, 1, 6000),
  chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank)) as material_md5 from context group by session_id, request_id""")
def _(t):
    return quality.eval_material(context(t, quality.MATERIAL_CHARS)).select("session_id", "request_id", "source_count", F.md5("material").alias("material_md5"))


RAW_EVAL = """'{"score": ' || cast(doc_id % 150 - 20 as string) || '.7, "verdict": "' || case doc_id % 5 when 0 then 'correct' when 1 then 'incomplete' when 2 then 'wrong' else 'unverifiable' end
  || '", "grounding_score": "' || cast(doc_id % 90 as string) || '", "completeness_score": ' || cast(quality * 100 as string) || ', "rationale": "' || repeat('ab ', cast(doc_id % 200 as int)) || '"}'"""


@query("m3_parse_eval", "", f"""
with raw as (select doc_id, quality, doc_id % 5 <> 2 as ok, case doc_id % 5 when 0 then 'correct' when 1 then 'incomplete' else 'unverifiable' end as v from labels)
select doc_id, case when ok then v end as verdict, cast(case when ok then greatest(0, least(100, trunc((doc_id % 150 - 20 || '.7')::double))) end as int) as score,
  cast(case when ok then doc_id % 90 end as int) as grounding_score, cast(case when ok then quality * 100 end as int) as completeness_score,
  cast(case when ok then 0 end as int) as relevance_score, case when ok then substr(repeat('ab ', doc_id % 200), 1, 400) end as rationale,
  case when not ok then 'INVALID_EVALUATOR_VERDICT' end as error from raw""")
def _(t):
    raw = t.given("labels").select("doc_id", F.expr(RAW_EVAL).alias("raw"))
    return quality.parse_eval(raw).drop("raw")


@query("m4_eval_outcome", "evaluations", """
select session_id, request_id, case when status <> 'failed' then 'succeeded' when attempts >= 3 then 'failed' else 'queued' end as status,
  case when status = 'failed' then repeat('x', 1000) end as last_error, case when status <> 'failed' then '2024-03-01 00:00:00' end as completed_at from evaluations""")
def _(t):
    ran = t.evaluations.withColumn("error", F.when(F.col("status") == "failed", F.repeat(F.lit("x"), F.lit(1500))))
    return quality.eval_outcome(ran, F.to_timestamp(F.lit("2024-03-01 00:00:00"))).select("session_id", "request_id", "status", "last_error", "completed_at")


@query("m5_eval_enqueue", "turns evaluations", f"""
, eligible as (select distinct session_id, request_id from turns where request_id is not null and sources_found > 0 and coalesce(error_code, '') <> 'MODEL_FAILED')
select coalesce(e.session_id, q.session_id) as session_id, coalesce(e.request_id, q.request_id) as request_id, coalesce(e.status, 'queued') as status, coalesce(e.attempts, 0) as attempts,
  case when q.request_id is not null then '2024-03-01 00:00:00' else {at('e.updated_at')} end as updated_at, e.max_attempts, e.verdict, e.score
from evaluations e full join eligible q on q.session_id = e.session_id and q.request_id = e.request_id""")
def _(t):
    turns = t.turns.filter("request_id is not null").select(
        "session_id", "request_id", "sources_found", F.when(F.col("error_code") == "MODEL_FAILED", F.col("error_code")).alias("generation_error"))
    return quality.eval_enqueue(t.evaluations, turns, F.to_timestamp(F.lit("2024-03-01 00:00:00")))


@query("m6_quality_summary", "evaluations", """
select count(*) as total, count(*) filter (where status = 'queued') as queued, count(*) filter (where status = 'running') as running,
  count(*) filter (where status = 'succeeded') as completed, count(*) filter (where status = 'failed') as failed, count(*) filter (where verdict = 'correct') as correct,
  count(*) filter (where verdict = 'incomplete') as incomplete, count(*) filter (where verdict = 'incorrect') as incorrect, count(*) filter (where verdict = 'unverifiable') as unverifiable,
  cast(round(100.0 * count(*) filter (where verdict = 'correct') / count(*) filter (where status = 'succeeded')) as bigint) as correct_rate from evaluations""")
def _(t):
    return quality.quality_summary(t.evaluations)


@query("m7_quality_coverage", "turns evaluations", """
, eligible as (select session_id, request_id from turns where has_meta and has_context and request_id is not null)
select e.n as eligible_turns, v.n as evaluated_turns, cast(round(100.0 * v.n / e.n) as bigint) as coverage_rate from (select count(*) as n from eligible) e,
  (select count(*) as n from evaluations where status = 'succeeded' and (session_id, request_id) in (select (session_id, request_id) from eligible)) v""")
def _(t):
    return quality.quality_coverage(t.telemetry(), t.evaluations)


@query("m8_attach_quality", "turns evaluations feedback_raw", KEPT + """
select t.id, e.status as evaluation_status, e.verdict, e.score, k.rating as learner_rating from turns t
left join evaluations e on e.session_id = t.session_id and e.request_id = t.request_id
left join kept k on k.session_id = t.session_id and k.request_id = t.request_id""")
def _(t):
    return quality.attach_quality(t.turns, t.evaluations, kept(t)).select("id", "evaluation_status", "verdict", "score", "learner_rating")
