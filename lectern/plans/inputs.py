"""The library's input tables derived from the given ones.

Each table is one SELECT that Spark and DuckDB both understand, so that a query and its check start from equal
rows. ``{name}`` stands for a given table. Every derivation reads its whole base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import prepare

GIVEN = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def text(x: str) -> str:
    return f"cast({x} as string)"


def uuid_of(x: str) -> str:
    m = f"md5({x})"
    return (f"(substr({m},1,8) || '-' || substr({m},9,4) || '-4' || substr({m},14,3) || '-8' || substr({m},18,3) "
            f"|| '-' || substr({m},21,12))")


def session_of(c: str) -> str:
    """Session id of a conversation: UUIDs, ids of tests and audits, and older learner ids."""
    return (f"case ({c}) % 6 when 0 then {uuid_of(f'{text(c)} || chr(115)')} when 1 then 'test-' || {text(c)} "
            f"when 2 then 'audit_' || {text(c)} else 'aluno-' || {text(c)} end")


_MESSAGE_TELEMETRY = """
  case when has_meta then case h % 4 when 0 then 'resumo' when 1 then 'quiz' when 2 then 'info' else 'livre' end end as mode,
  case when has_meta then case (h * 7) % 5 when 0 then 'QUIZ_SEGUNDA_TENTATIVA' when 1 then 'QUIZ_EM_ANDAMENTO' when 2 then 'LIVRE' when 3 then 'QUIZ_AGUARDANDO_TEMA' else 'MENU_PRINCIPAL' end end as state_before,
  case when has_meta then case (h * 3) % 5 when 0 then 'QUIZ_EM_ANDAMENTO' when 1 then 'QUIZ_SEGUNDA_TENTATIVA' when 2 then 'QUIZ_CONCLUIDO' when 3 then 'LIVRE' else 'MENU_PRINCIPAL' end end as state_after,
  case when has_meta then case when h % 3 = 0 then 'Tema ' || cast(h % 12 as string) when h % 3 = 1 then '  ' end end as current_topic,
  case when has_meta then case h % 3 when 0 then 'model-a' when 1 then 'model-b' end end as model_used,
  case when has_meta then h % 8 = 0 end as fallback_used,
  case when has_meta and h % 8 = 0 then case h % 16 when 0 then 'MODEL_TIMEOUT' else 'ALL_MODELS_FAILED' end end as fallback_reason,
  case when has_meta and h % 10 <> 9 then h % 6 > 1 end as has_context,
  cast(case when has_meta then case when h % 6 > 1 then h % 6 else 0 end end as int) as sources_found,
  case when has_meta then ms * 0.5 end as lat_embedding,
  case when has_meta then case when h % 17 = 0 then -1.0 else ms * 2.0 end end as lat_retrieval,
  case when has_meta then ms * 8.0 end as lat_generation,
  case when has_meta and h % 19 <> 0 then ms * 10.5 end as lat_total,
  case when has_meta then case h % 11 when 0 then 'EMBEDDING_FAILED' when 1 then 'RETRIEVAL_FAILED' when 2 then 'NO_RELEVANT_CONTEXT' when 3 then 'MODEL_FAILED' when 4 then '' end end as error_code
"""

TABLES = {
    # chat messages from conversations
    "messages": f"""
select id, conv_id, turn, session_id, request_id, role, content, created_at, h, has_meta, {_MESSAGE_TELEMETRY}
from (
  select {text('conv_id')} || '-' || {text('turn')} as id, conv_id, turn, {session_of('conv_id')} as session_id,
    case when conv_id % 7 <> 3 then {uuid_of("'r' || " + text('conv_id') + " || ':' || " + text("case role when 'assistant' then turn - 1 else turn end"))} end as request_id,
    role, text as content,
    timestamp '2024-01-01 00:00:00' + interval '1' minute * (conv_id * 60 + turn) as created_at,
    conv_id * 8 + turn as h, role = 'assistant' and (conv_id * 8 + turn) % 9 <> 0 as has_meta,
    cast((conv_id * 13 + turn * 7) % 400 as double) as ms
  from {{conversations}}
) m""",
    # instrumented assistant turns from events
    "turns": f"""
select id, event_id, session_id, request_id, role, content, created_at, h, has_meta, {_MESSAGE_TELEMETRY}
from (
  select 'e' || {text('event_id')} as id, event_id,
    case when user_id % 10 = 0 then 'acceptance-' else 'aluno-' end || {text('user_id')} as session_id,
    case when event_id % 11 <> 0 then {uuid_of("'e' || " + text('event_id'))} end as request_id,
    'assistant' as role, event_type as content, cast(ts as timestamp) as created_at,
    cast(regexp_extract(props, '([0-9]+)', 1) as bigint) + event_id as h, event_type <> 'signup' as has_meta,
    value as ms
  from {{events}}
) m""",
    # star ratings as they arrive: some invalid, some without session or request
    "feedback_raw": f"""
select case when event_id % 9 = 0 then '  ' else case when user_id % 10 = 0 then 'acceptance-' else 'aluno-' end || {text('user_id')} end as session_id,
  case event_id % 5 when 0 then 'no-uuid' when 1 then null else {uuid_of("'e' || " + text('event_id - event_id % 3'))} end as request_id,
  case event_type when 'error' then '4.5' when 'click' then {text('event_id % 8')} when 'view' then ' ' || {text('event_id % 5 + 1')} else {text('event_id % 5 + 1')} end as rating,
  cast(ts as timestamp) as created_at
from {{events}}""",
    # evaluations of the turns that labels point at
    "evaluations": f"""
select t.session_id, t.request_id,
  case when l.doc_id % 9 = 0 then 'queued' when l.doc_id % 9 = 1 then 'running' when l.doc_id % 9 = 2 then 'failed' else 'succeeded' end as status,
  cast(l.doc_id % 4 as int) as attempts, 3 as max_attempts,
  case when l.doc_id % 9 > 2 then case when l.toxic = 1 then 'incorrect' when l.quality = 1 then 'correct' when l.doc_id % 2 = 0 then 'incomplete' else 'unverifiable' end end as verdict,
  case when l.doc_id % 9 > 2 then cast(l.doc_id % 101 as int) end as score, t.created_at as updated_at
from {{labels}} l join (
  select event_id, case when user_id % 10 = 0 then 'acceptance-' else 'aluno-' end || {text('user_id')} as session_id,
    {uuid_of("'e' || " + text('event_id'))} as request_id, cast(ts as timestamp) as created_at from {{events}}
) t on t.event_id = l.doc_id""",
    # one sync job per document
    "jobs": f"""
select 'j' || {text('doc_id')} as id, 'f' || {text('doc_id')} as drive_file_id,
  case doc_id % 3 when 0 then 'new' when 1 then 'changed' else 'removed' end as action, source as file_info,
  case when doc_id % 10 < 3 then 'queued' when doc_id % 10 < 5 then 'running' when doc_id % 10 < 8 then 'succeeded' else 'failed' end as status,
  cast(doc_id % 4 as int) as attempts, 3 as max_attempts,
  case when doc_id % 10 in (3, 4) then timestamp '2024-01-01 00:00:00' + interval '1' minute * (doc_id * 7) end as lease_expires_at,
  case when doc_id % 10 >= 8 and doc_id % 20 <> 19 then substr(text, 1, 400) when doc_id % 10 = 4 then 'earlier error' end as last_error,
  timestamp '2024-01-01 00:00:00' + interval '1' minute * ((doc_id * 37) % 50000) as created_at,
  timestamp '2024-01-01 00:00:00' + interval '1' minute * ((doc_id * 53) % 60000) as updated_at
from {{documents}}""",
    # the remote listing, and the manifest of an earlier run: ids moved by 37, every 5th text changed, ...
    "listing": f"""
select 'f' || {text('doc_id')} as id, 'doc' || {text('doc_id % 900')} || '.pdf' as name,
  case when doc_id % 4 <> 0 then 'ROOT/' || source || '/doc' || {text('doc_id % 900')} || '.pdf' end as drive_path,
  case when doc_id % 2 = 0 then 'application/pdf' end as mime_type,
  '2024-02-' || lpad({text('doc_id % 28 + 1')}, 2, '0') || 'T10:00:00Z' as modified_time,
  case when doc_id % 3 = 0 then '' else md5(text) end as md5_checksum, n_chars
from {{documents}}""",
    "manifest": f"""
select 'f' || {text('doc_id + 37')} as drive_file_id,
  case when (doc_id + 37) % 11 = 0 then 'old' else 'doc' || {text('(doc_id + 37) % 900')} || '.pdf' end as name,
  case when (doc_id + 37) % 4 <> 0 then 'ROOT/' || 'src' || {text('(doc_id + 37) % 20')} || '/doc' || {text('(doc_id + 37) % 900')} || '.pdf' end as drive_path,
  case when doc_id % 3 = 0 then 'application/pdf' end as mime_type,
  '2024-02-' || lpad({text('case when (doc_id + 37) % 5 = 0 then 1 else (doc_id + 37) % 28 + 1 end')}, 2, '0') || 'T10:00:00+00:00' as modified_time,
  case when doc_id % 7 = 0 then md5(text) end as md5_checksum, cast(n_chars as int) as chunks_count,
  case when (doc_id + 37) % 13 = 0 then 'error' else 'active' end as status
from {{documents}}""",
    # chunk table: documents as chunks, five per file
    "chunks": f"""
select {text('doc_id')} as id, text as content,
  case when doc_id % 10 = 0 then '' when doc_id % 10 < 6 then 'biblioteca__' || source || '_v1.pdf' else source end as source,
  case when doc_id % 8 <> 7 then 'f' || {text('cast(floor(doc_id / 5) as bigint)')} end as drive_file_id,
  cast(doc_id % 5 + 1 as int) as page_number, cast(doc_id % 5 as int) as chunk_index,
  case when doc_id % 6 <> 5 then md5(text) end as content_hash, doc_id, lang
from {{documents}}""",
    # health checks from events
    "checks": f"""
select case event_id % 3 when 0 then 'supabase' when 1 then 'drive_sync' else 'quality_worker' end as component,
  case event_type when 'error' then 'critical' when 'click' then 'warning' else 'healthy' end as status,
  props as detail, cast(ts as timestamp) as checked_at, event_id
from {{events}}""",
    # a folder tree: regions and nations are folders, customers are files
    "nodes": f"""
select 'root' as id, cast(null as string) as parent, 'root' as name, 'application/vnd.google-apps.folder' as mime_type, false as trashed
union all select 'r' || {text('r_regionkey')}, 'root', r_name, 'application/vnd.google-apps.folder', false from {{region}}
union all select 'n' || {text('n_nationkey')}, 'r' || {text('n_regionkey')}, n_name, 'application/vnd.google-apps.folder', n_nationkey = 7 from {{nation}}
union all select 'c' || {text('c_custkey')}, 'n' || {text('c_nationkey')}, c_name,
  case c_custkey % 4 when 0 then 'application/pdf' when 1 then 'application/vnd.google-apps.document' when 2 then 'image/png'
    else 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' end, c_acctbal < 0 from {{customer}}""",
    # the session table: knows conversations 10 and up, and ten that have no messages
    "known_sessions": f"""
select {session_of('c')} as id, timestamp '2024-01-01 00:00:00' + interval '1' hour * c as created_at,
  timestamp '2024-01-02 00:00:00' + interval '1' hour * c as updated_at
from (select distinct conv_id + 10 as c from {{conversations}}) s""",
    # a dialogue with the phrases that move a session, over the same turns as the conversations
    "dialog": f"""
select session_id, turn, role, h, created_at, case
    when role = 'assistant' then case h % 9 when 0 then 'Qual tema da disciplina você quer no resumo?'
      when 1 then 'Qual tema você quer no quiz? Farei três perguntas.' when 2 then 'Sua resposta está incorreta. Tente novamente!'
      when 3 then 'Correto! **Questão ' || {text('h % 3 + 1')} || ':** ' || text when 4 then text || ' Deseja aprofundar este tema?'
      when 5 then text || ' Deseja fazer outra pergunta?' when 6 then 'QUESTAO 2 : ' || text else text end
    when role = 'user' then case h % 16 when 0 then 'Olá, tutor' when 1 then 'Voltar ao menu' when 2 then 'Resumo de Conteúdo'
      when 3 then 'Quiz sobre feridas ' || {text('h')} when 4 then 'B' when 5 then 'Aprofundar' when 6 then 'Seja mais conciso'
      when 7 then 'outro tema' when 8 then 'Informações sobre avaliação' when 9 then 'Encerrar Sessão' when 10 then 'opção 2'
      when 11 then 'quero um resumo de hemostasia' when 12 then 'a' when 13 then '  ' when 14 then '3' else text end
    else text end as content
from (
  select conv_id * 8 + turn as h, turn, role, text, 'dlg-' || {text('conv_id')} as session_id,
    timestamp '2024-01-01 00:00:00' + interval '1' minute * (conv_id * 60 + turn) as created_at
  from {{conversations}}
) d""",
}

TELEMETRY = [
    "mode", "state_before", "state_after", "current_topic", "model_used", "fallback_used", "fallback_reason",
    "has_context", "sources_found", "error_code",
]


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derived(spark: SparkSession, folder: str, name: str, read=None) -> DataFrame:
    """A derived table by name; ``read`` gives the base tables in another way than a plain scan."""
    sql = TABLES[name]
    read = read or (lambda t: given(spark, folder, t))
    used = {t: read(t) for t in GIVEN if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def nested(flat: DataFrame) -> DataFrame:
    """Telemetry columns folded into the ``metadata`` struct, null where a message has none.

    The retrieval array lists ``sources_found`` documents; their ids follow from the turn."""
    retrieval = F.transform(
        F.sequence(F.lit(1), F.greatest(F.coalesce("sources_found", F.lit(0)), F.lit(1))),
        lambda i: F.struct(
            F.when((F.col("h") + i) % 10 == 0, F.concat(F.lit("source:src"), ((F.col("h") + i) % 20).cast("string")))
            .when((F.col("h") + i) % 10 == 1, F.lit(""))
            .otherwise(((F.col("h") * 7 + i) % 1000).cast("string")).alias("document_id"),
            F.concat(F.lit("src"), ((F.col("h") + i % 2) % 20).cast("string")).alias("source"),
            i.alias("rank"), (((F.col("h") + i * 13) % 100) / 100.0).cast("double").alias("similarity")))
    retrieval = F.when(F.coalesce("sources_found", F.lit(0)) > 0, retrieval).otherwise(F.slice(retrieval, 1, 0))
    latency = F.struct(*[F.col(f"lat_{s}").alias(s) for s in ("embedding", "retrieval", "generation", "total")])
    metadata = F.struct(*[F.col(c) for c in TELEMETRY], retrieval.alias("retrieval"), latency.alias("latency_ms"))
    lat = [f"lat_{s}" for s in ("embedding", "retrieval", "generation", "total")]
    return flat.withColumn("metadata", F.when(F.col("has_meta"), metadata)).drop(*TELEMETRY, *lat)


# The same retrieval entries as rows, for the checks.
RETRIEVAL_ROWS = """
select t.*, i as rank,
  case when (h + i) % 10 = 0 then 'source:src' || cast((h + i) % 20 as string) when (h + i) % 10 = 1 then ''
    else cast((h * 7 + i) % 1000 as string) end as document_id,
  'src' || cast((h + i % 2) % 20 as string) as doc_source, ((h + i * 13) % 100) / 100.0 as similarity
from turns t, (select unnest([1, 2, 3, 4, 5]) as i) k where t.sources_found >= i"""


def for_duckdb(sql: str) -> str:
    for t in GIVEN:
        sql = sql.replace(f"{{{t}}}", t)
    return sql


def with_tables(names: str, body: str) -> str:
    """A check: the derived tables it names as CTEs, then its body."""
    parts = []
    for n in names.split():
        parts.append(f"{n} as ({RETRIEVAL_ROWS if n == 'hits' else for_duckdb(TABLES[n])}\n)")
    return f"with recursive {', '.join(parts)}\n{body.strip()}" if parts else body.strip()
