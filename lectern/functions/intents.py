"""Message classification as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .base import col, matches, present, strip
from .text import normalize_input, strip_accents

# Messages (after normalize_input) that select each intent, in order of precedence.
INTENT_PHRASES = {
    "menu_return": [
        "menu", "voltar", "inicio", "home", "opcoes", "opcao", "voltar pro comeco", "quero o menu",
        "menu principal", "voltar ao menu", "quero voltar ao menu", "voltar para o menu",
        "ir para o menu", "retornar ao menu", "quero voltar",
    ],
    "menu_resumo": ["1", "opcao 1", "resumo de conteudo", "1 resumo de conteudo", "resumo"],
    "menu_quiz": [
        "2", "opcao 2", "quiz da disciplina", "quiz", "simulado de prova", "simulado",
        "2 quiz da disciplina", "2 simulado de prova",
    ],
    "menu_info": [
        "3", "opcao 3", "informacoes da disciplina", "informacao da disciplina",
        "3 informacoes da disciplina", "informacoes", "informacao",
    ],
    "farewell": [
        "4", "opcao 4", "encerrar sessao", "encerrar", "sair", "tchau", "bye", "adeus", "finalizar",
    ],
    "aprofundar": ["aprofundar", "aprofundar este tema", "aprofundar mais", "aprofundar o tema"],
    "outro_tema": ["escolher outro tema", "outro tema", "mudar tema", "trocar tema"],
    "reformular_conciso": [
        "seja mais conciso", "seja mais concisa", "mais conciso", "mais concisa", "resuma mais",
        "resuma isso", "simplifique", "explique de outra forma", "resposta mais curta", "mais curto",
        "mais curta",
    ],
}
# Words that make a message of up to three words a greeting.
GREETING_WORDS = ["oi", "ola", "opa", "bom", "boa", "hello", "hi", "salve", "comecar", "tutor", "bot"]


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def intent_of_normalized(norm: Column) -> Column:
    words = F.split(norm, " ")
    short_menu = (
        (F.length(norm) < 30)
        & F.rlike(norm, F.lit("(?<!\\w)voltar(?!\\w)"))
        & F.rlike(norm, F.lit("(?<!\\w)menu(?!\\w)"))
    )
    intent = F.when(norm == "", F.lit("greeting"))
    for name, phrases in INTENT_PHRASES.items():
        hit = norm.isin(phrases)
        intent = intent.when(hit | short_menu if name == "menu_return" else hit, F.lit(name))
    greeting = (F.size(words) <= 3) & F.arrays_overlap(words, _strings(GREETING_WORDS))
    return intent.when(greeting, F.lit("greeting")).otherwise(F.lit("content"))


def detect_intent(c: Column | str) -> Column:
    """One of ten intents."""
    return intent_of_normalized(normalize_input(c))


# The older backend's keyword sets.
LEGACY_END_WORDS = [
    "sair", "fechar", "encerrar", "terminar", "fim", "tchau", "bye", "encerrar sessao",
    "terminar sessao", "finalizar sessao", "fechar sessao",
]
LEGACY_MENU_WORDS = [
    "menu", "voltar", "inicio", "home", "opcoes", "menu principal", "voltar ao menu",
    "voltar pro menu", "voltar para o menu", "pagina inicial",
]
LEGACY_COURTESY_WORDS = [
    "oi", "ola", "opa", "bom", "dia", "boa", "tarde", "noite", "tudo", "bem", "como", "vai", "voce",
    "voces", "e", "ai", "hello", "hi", "salve", "tutor", "bot", "ia", "sistema", "quem", "o", "que",
    "faz", "pode", "fazer", "nome", "seu", "funciona", "ajuda", "me", "ajudar", "estudar", "com",
    "obrigado", "obrigada", "valeu", "grato", "grata",
]


def legacy_normalize(c: Column | str) -> Column:
    """ASCII letters only: marks and any other non-ASCII character vanish, punctuation is a blank."""
    ascii_only = F.regexp_replace(strip_accents(col(c)), "[^\\x00-\\x7F]", "")
    return F.regexp_replace(strip(F.lower(ascii_only)), "[^a-z0-9_\\s]", " ")


def legacy_intents(c: Column | str) -> Column:
    """struct<is_end, is_menu, is_courtesy>; end and menu test substrings, as the older backend did."""
    norm = legacy_normalize(c)
    words = F.filter(F.split(norm, "\\s+"), lambda w: w != "")
    contains_any = lambda keys: F.exists(_strings(keys), lambda k: F.contains(norm, k))
    courtesy = (F.size(words) > 0) & (F.size(F.array_except(words, _strings(LEGACY_COURTESY_WORDS))) == 0)
    return F.struct(
        F.coalesce(contains_any(LEGACY_END_WORDS), F.lit(False)).alias("is_end"),
        F.coalesce(contains_any(LEGACY_MENU_WORDS), F.lit(False)).alias("is_menu"),
        F.coalesce(courtesy, F.lit(False)).alias("is_courtesy"),
    )


# How a request names its subject in the same message, per mode: on the text without accents, and as the
# learner may spell it. Without lookaround, so other engines can run them.
INLINE_REQUESTS = {
    "quiz": (
        r"^(?:quero\s+(?:um\s+)?|queria\s+(?:um\s+)?)?(?:fazer\s+)?(?:simulado(?: de prova)?|quiz(?: da disciplina)?|opcao 2|2)\s*(?:sobre|de|da|do|com|-|:)?\s*",
        r"^(?:quero\s+(?:um\s+)?|queria\s+(?:um\s+)?)?(?:fazer\s+)?(?:simulado(?: de prova)?|quiz(?: da disciplina)?|op[cç][aã]o 2|2)\s*(?:sobre|de|da|do|com|-|:)?\s*",
    ),
    "resumo": (
        r"^(?:quero\s+(?:um\s+)?|queria\s+(?:um\s+)?)?(?:fazer\s+)?(?:resumo(?: de conteudo)?|opcao 1|1)\s*(?:sobre|de|da|do|com|-|:)?\s*",
        r"^(?:quero\s+(?:um\s+)?|queria\s+(?:um\s+)?)?(?:fazer\s+)?(?:resumo(?: de conte[uú]do)?|op[cç][aã]o 1|1)\s*(?:sobre|de|da|do|com|-|:)?\s*",
    ),
    "info": (
        r"^(?:quero\s+(?:saber\s+)?|queria\s+(?:saber\s+)?)?(?:informacoes|informacao|opcao 3|3)\s*(?:sobre|de|da|do|com|-|:)?\s*",
        r"^(?:quero\s+(?:saber\s+)?|queria\s+(?:saber\s+)?)?(?:informa[cç][oõ]es|informa[cç][aã]o|op[cç][aã]o 3|3)\s*(?:sobre|de|da|do|com|-|:)?\s*",
    ),
}


def inline_pattern(mode: str, accented: bool) -> str:
    """Regex of the opening of an inline request."""
    return INLINE_REQUESTS[mode][int(accented)]


def inline_topic(c: Column | str, mode: str, norm: Column | None = None) -> Column:
    """Topic of an inline request of this mode, null when the message is not one.

    The request is recognised on the normalised text and the topic cut from the original one."""
    wanted = matches(normalize_input(c) if norm is None else norm, inline_pattern(mode, False) + "(.+)$")
    topic = strip(F.regexp_replace(col(c), "(?iu)" + inline_pattern(mode, True), ""))
    return F.when(wanted, present(topic))


def extract_inline(c: Column | str, norm: Column | None = None) -> Column:
    """struct<mode, topic>, quiz tried first; null when the message is no inline request.

    ``norm`` is the normalised message where the caller has it already."""
    request = None
    for mode in INLINE_REQUESTS:
        topic = inline_topic(c, mode, norm)
        entry = F.when(topic.isNotNull(), F.struct(F.lit(mode).alias("mode"), topic.alias("topic")))
        request = entry if request is None else F.coalesce(request, entry)
    return request


# Fixed value: phrase by which an answer asks for a second attempt.
RETRY_PHRASE = "(?isu)resposta est[aá] incorreta.{0,80}tente novamente"


def asks_retry(answer: Column | str) -> Column:
    return matches(answer, RETRY_PHRASE)


def next_question_missing(generation_mode, quiz_question, answer) -> Column:
    """A quiz reply before the last question that neither asks for a retry nor shows the next one."""
    answering = col(generation_mode).isin("simulado_respondendo", "simulado_segunda_tentativa")
    current = F.greatest(F.lit(1), col(quiz_question))
    shown = F.rlike(
        col(answer), F.concat(F.lit("(?iu)quest[aã]o\\s*"), (current + 1).cast("string"), F.lit("\\s*:"))
    )
    return F.coalesce(answering & (current < 3) & ~asks_retry(answer) & ~shown, F.lit(False))


def response_kind(kind, failed, generation_mode, answer) -> Column:
    """One of seven kinds of response."""
    mode = col(generation_mode)
    return (
        F.when(col(kind) == "fast", F.lit("navigation"))
        .when(F.coalesce(col(failed), F.lit(False)), F.lit("fallback"))
        .when(mode.isin("resumo", "resumo_aprofundar", "resumo_reformular"), F.lit("summary"))
        .when(mode == "info", F.lit("info"))
        .when(mode == "simulado_tema", F.lit("quiz_question"))
        .when(
            mode.isin("simulado_respondendo", "simulado_segunda_tentativa"),
            F.when(matches(answer, "(?iu)quest[aã]o\\s*[0-9]+\\s*:"), F.lit("quiz_question"))
            .otherwise(F.lit("quiz_feedback")),
        )
        .otherwise(F.lit("free"))
    )


# Fixed value: words that mark a question about the course itself.
COURSE_WORDS = (
    "prof|hor[aá]r|atend|cron|calend|nota|avali|plano|trabalho|conte[uú]do|carga|disciplin|ementa|"
    "frequ[eê]nc|moodle|email|contato|m[eé]dia|prova"
)
PLAN_PATTERN = "administrativo__plano_ensino%"


def route_threshold(generation_mode, text) -> Column:
    """struct<threshold, source_pattern> of a search: whole plan, course question or study question."""
    info = F.coalesce(col(generation_mode) == "info", F.lit(False))
    return F.struct(
        F.when(info, F.lit(-1.0))
        .when(matches(text, f"(?iu){COURSE_WORDS}"), F.lit(0.25))
        .otherwise(F.lit(0.35)).alias("threshold"),
        F.when(info, F.lit(PLAN_PATTERN)).alias("source_pattern"),
    )


def search_text(topic, question) -> Column:
    return F.coalesce(present(topic), col(question))
