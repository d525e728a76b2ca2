"""The session fold as a recursive SQL query, one turn per step: the check of ``flow.fold_turns``."""

from __future__ import annotations

from .chat_sql import INTENT_SQL, SPACES, inline_sql, norm_sql

_FIRST = "act in ('greeting', 'menu_return')"
_MENU = "act in ('greeting', 'menu_return', 'farewell', 'menu_resumo', 'menu_quiz', 'menu_info')"

# needs the table ``dialog`` in front; gives ``fold`` with one row per turn and rn = 0 for the start
FOLD = f"""
, exchanges as (select u.session_id, u.turn, u.h, u.message, a.answer, row_number() over (partition by u.session_id order by u.turn) as rn
  from (select session_id, turn, h, content, trim(content, {SPACES}) as message from dialog where role = 'user') u
  left join (select session_id, turn - 1 as turn, content as answer from dialog where role = 'assistant') a on a.session_id = u.session_id and a.turn = u.turn)
, inlined as (select *, {INTENT_SQL} as intent, {inline_sql('quiz')} as iq, {inline_sql('resumo')} as ir, {inline_sql('info')} as ii
  from (select *, message as content, {norm_sql('message')} as n from exchanges))
, ev as (select session_id, turn, rn, message, intent, case when iq is not null then 'quiz' when ir is not null then 'resumo' when ii is not null then 'info' end as inline_mode,
    coalesce(iq, ir, ii) as inline_topic, regexp_matches(n, '^[abcd]$') as letter, coalesce(regexp_matches(answer, '(?is)resposta est[aá] incorreta.{{0,80}}tente novamente'), false) as retry,
    h % 10 = 0 as failed from inlined)
, fold(session_id, rn, turn, intent, kind, fast_response, generation_mode, turn_topic, state_before, state_decided, state, mode, topic, asked, tried, q, a, revision) as (
  select distinct session_id, 0::bigint, null::bigint, '', '', '', '', '', '', '', 'MENU_PRINCIPAL', 'livre', '', 0, 0, 0, 0, 0::bigint from ev
  union all
  select session_id, rn, turn, intent, kind, fast_response, generation_mode, turn_topic, state, d_state,
    case when undone then state when act = 'answer' then f_state else d_state end, case when undone then mode when act = 'answer' then 'quiz' else d_mode end,
    case when undone then topic else d_topic end, asked, tried, case when undone then q when act = 'answer' then f_q else d_q end,
    case when undone then a when act = 'answer' then f_a else d_a end, revision + case when undone or act = 'invalid' then 0 else 1 end
  from (
    select *, failed and kind = 'generate' as undone,
      case when second then case when asked >= 3 then 'QUIZ_CONCLUIDO' else 'QUIZ_EM_ANDAMENTO' end when retry then 'QUIZ_SEGUNDA_TENTATIVA' when asked >= 3 then 'QUIZ_CONCLUIDO' else 'QUIZ_EM_ANDAMENTO' end as f_state,
      case when retry and not second then asked when asked >= 3 then 3 else asked + 1 end as f_q, case when retry and not second then 2 when asked >= 3 then tried else 1 end as f_a
    from (
      select *, case when {_MENU} or act = 'invalid' then 'fast' else 'generate' end as kind,
        case act when 'greeting' then 'greeting' when 'menu_return' then 'menu' when 'farewell' then 'farewell' when 'menu_resumo' then 'resumo_menu' when 'menu_quiz' then 'quiz_menu'
          when 'menu_info' then 'info_menu' when 'invalid' then 'quiz_invalid' end as fast_response,
        case when act in ('inline_resumo', 'topic_resumo') then 'resumo' when act in ('inline_quiz', 'topic_quiz') then 'simulado_tema' when act in ('inline_info', 'topic_info') then 'info'
          when act = 'deepen' then 'resumo_aprofundar' when act = 'shorten' then 'resumo_reformular' when act = 'free' then 'livre'
          when act = 'answer' then case when second then 'simulado_segunda_tentativa' else 'simulado_respondendo' end end as generation_mode,
        case when act like 'inline%' then inline_topic when act like 'topic%' then message when {_MENU} and act <> 'farewell' then '' else topic end as turn_topic,
        case when {_FIRST} then 'MENU_PRINCIPAL' when act = 'farewell' then 'ENCERRADA' when act = 'menu_resumo' then 'RESUMO_AGUARDANDO_TEMA' when act = 'menu_quiz' then 'QUIZ_AGUARDANDO_TEMA'
          when act in ('menu_info', 'inline_info', 'topic_info') then 'INFORMACOES_AGUARDANDO_PERGUNTA' when act in ('inline_resumo', 'topic_resumo') then 'RESUMO_CONCLUIDO'
          when act in ('inline_quiz', 'topic_quiz') then 'QUIZ_EM_ANDAMENTO' when act = 'free' then 'LIVRE' else state end as d_state,
        case when {_FIRST} or act in ('farewell', 'free') then 'livre' when act in ('menu_resumo', 'inline_resumo', 'topic_resumo', 'deepen', 'shorten') then 'resumo'
          when act in ('menu_quiz', 'inline_quiz', 'topic_quiz') then 'quiz' when act in ('menu_info', 'inline_info', 'topic_info') then 'info' else mode end as d_mode,
        case when act like 'inline%' then inline_topic when act like 'topic%' then message when {_MENU} and act <> 'farewell' then '' else topic end as d_topic,
        case when act in ('inline_quiz', 'topic_quiz') then 1 when act = 'answer' then greatest(1, q) else q end as asked,
        case when act in ('inline_quiz', 'topic_quiz') then 1 when act = 'answer' then case when second then 2 else 1 end else a end as tried,
        case when act in ('inline_quiz', 'topic_quiz') then 1 when {_MENU} or act in ('inline_resumo', 'inline_info') then 0 else q end as d_q,
        case when act in ('inline_quiz', 'topic_quiz') then 1 when {_MENU} or act in ('inline_resumo', 'inline_info') then 0 else a end as d_a
      from (
        select f.session_id, e.rn, e.turn, e.message, e.intent, e.inline_topic, e.retry, e.failed, f.state, f.mode, f.topic, f.q, f.a, f.revision,
          f.state = 'QUIZ_SEGUNDA_TENTATIVA' or f.a = 2 as second,
          case when e.intent in ('greeting', 'menu_return', 'farewell', 'menu_resumo', 'menu_quiz', 'menu_info') then e.intent
            when e.intent = 'outro_tema' then case f.mode when 'quiz' then 'menu_quiz' when 'info' then 'menu_info' else 'menu_resumo' end
            when e.inline_mode is not null then 'inline_' || e.inline_mode
            when e.intent = 'aprofundar' then case when f.state = 'RESUMO_CONCLUIDO' and f.topic <> '' then 'deepen' else 'menu_resumo' end
            when e.intent = 'reformular_conciso' and f.state = 'RESUMO_CONCLUIDO' and f.topic <> '' then 'shorten'
            when f.state in ('QUIZ_EM_ANDAMENTO', 'QUIZ_SEGUNDA_TENTATIVA') then case when e.letter then 'answer' else 'invalid' end
            when f.state = 'RESUMO_AGUARDANDO_TEMA' then 'topic_resumo' when f.state = 'QUIZ_AGUARDANDO_TEMA' then 'topic_quiz'
            when f.state = 'INFORMACOES_AGUARDANDO_PERGUNTA' then 'topic_info' else 'free' end as act
        from fold f join ev e on e.session_id = f.session_id and e.rn = f.rn + 1))))
"""

RESOLVED = FOLD + """
select session_id, turn, intent, kind, fast_response, generation_mode, turn_topic as topic, state_before, state_decided, asked as quiz_question, tried as quiz_attempt
from fold where rn > 0"""

STEPS = FOLD + """
select session_id, turn, state_before, state as state_after, topic as current_topic, revision from fold where rn > 0"""

FINAL = FOLD + """
select session_id, state, mode, topic as current_topic, q as quiz_question, a as quiz_attempt, 'v1' as flow_version, revision from (
  select *, row_number() over (partition by session_id order by rn desc) as last from fold where rn > 0) where last = 1"""
