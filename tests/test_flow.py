import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import intents
from lectern.operators import flow, sessions

TURNS = "session_id string, turn long, message string, answer string, failed boolean"
STATES = "session_id string, state string, mode string, current_topic string, quiz_question int, quiz_attempt int, revision long"
RETRY = "Sua resposta está incorreta. Tente novamente! Qual das alternativas você escolheria agora?"


@pytest.fixture(scope="module")
def decide(spark):
    """Decision of one turn from a stored state."""

    def run(message, answer=None, failed=False, **stored):
        state = {"state": "MENU_PRINCIPAL", "mode": "livre", "topic": "", "question": 0, "attempt": 0, "revision": 5, **stored}
        turns = spark.createDataFrame([("s", 0, message, answer, failed)], TURNS)
        states = spark.createDataFrame([("s", state["state"], state["mode"], state["topic"], state["question"], state["attempt"], state["revision"])], STATES)
        return flow.fold_turns(turns, states).first()

    return run


QUIZ = dict(state="QUIZ_EM_ANDAMENTO", mode="quiz", topic="feridas", question=1, attempt=1)
SUMMARY = dict(state="RESUMO_CONCLUIDO", mode="resumo", topic="hemostasia")
# message, answer, stored state -> expected columns
CASES = [
    ("Resumo de Conteúdo", None, {}, dict(kind="fast", fast_response="resumo_menu", state_after="RESUMO_AGUARDANDO_TEMA", revision=6)),
    ("Resumo sobre hemostasia", "ok", {}, dict(generation_mode="resumo", topic="hemostasia", state_after="RESUMO_CONCLUIDO")),
    ("Infecção de sítio cirúrgico", "ok", dict(state="RESUMO_AGUARDANDO_TEMA", mode="resumo"), dict(generation_mode="resumo", current_topic="Infecção de sítio cirúrgico")),
    ("Aprofundar", "ok", SUMMARY, dict(generation_mode="resumo_aprofundar", topic="hemostasia", state_after="RESUMO_CONCLUIDO")),
    ("Aprofundar", None, {}, dict(kind="fast", state_after="RESUMO_AGUARDANDO_TEMA")),
    ("Seja mais conciso", "ok", SUMMARY, dict(generation_mode="resumo_reformular", state_after="RESUMO_CONCLUIDO")),
    ("Escolher outro tema", None, SUMMARY, dict(state_after="RESUMO_AGUARDANDO_TEMA", current_topic="")),
    ("outro tema", None, QUIZ, dict(state_after="QUIZ_AGUARDANDO_TEMA", fast_response="quiz_menu", question_after=0)),
    ("Quiz sobre feridas", "ok", {}, dict(generation_mode="simulado_tema", state_after="QUIZ_EM_ANDAMENTO", question_after=1, current_topic="feridas")),
    ("B", RETRY, QUIZ, dict(state_before="QUIZ_EM_ANDAMENTO", state_after="QUIZ_SEGUNDA_TENTATIVA", question_after=1, attempt_after=2, revision=6)),
    ("não sei", None, QUIZ, dict(kind="fast", fast_response="quiz_invalid", state_after="QUIZ_EM_ANDAMENTO", question_after=1, attempt_after=1, revision=5)),
    ("A", "Correto!\n\n**Questão 2:** ...", QUIZ, dict(generation_mode="simulado_respondendo", state_after="QUIZ_EM_ANDAMENTO", question_after=2, attempt_after=1)),
    ("A", "A alternativa correta é a C.", {**QUIZ, "state": "QUIZ_SEGUNDA_TENTATIVA", "attempt": 2}, dict(generation_mode="simulado_segunda_tentativa", state_after="QUIZ_EM_ANDAMENTO", question_after=2)),
    ("A", "Correto! Deseja continuar o quiz?", {**QUIZ, "question": 3}, dict(state_after="QUIZ_CONCLUIDO", question_after=3)),
    ("Informações sobre critérios de avaliação", "ok", {}, dict(generation_mode="info", topic="critérios de avaliação", mode="info")),
    ("Voltar ao menu principal", None, {**QUIZ, "question": 2}, dict(state_after="MENU_PRINCIPAL", mode="livre", current_topic="", question_after=0)),
    ("encerrar", None, SUMMARY, dict(state_after="ENCERRADA", current_topic="hemostasia", topic="hemostasia")),
    ("e se sangrar muito?", "ok", SUMMARY, dict(generation_mode="livre", topic="hemostasia", state_after="LIVRE")),
    ("qual a nota?", "ok", dict(state="INFORMACOES_AGUARDANDO_PERGUNTA", mode="info"), dict(generation_mode="info", current_topic="qual a nota?")),
]


@pytest.mark.parametrize("message,answer,stored,want", CASES)
def test_transition(decide, message, answer, stored, want):
    got = decide(message, answer, **stored).asDict()
    assert {k: got[k] for k in want} == want


def test_failed_answer_leaves_the_state(decide):
    got = decide("Quiz sobre feridas", None, failed=True)
    assert (got.state_decided, got.state_after, got.current_topic, got.revision) == ("QUIZ_EM_ANDAMENTO", "MENU_PRINCIPAL", "", 5)
    got = decide("A", RETRY, failed=True, **QUIZ)
    assert (got.state_after, got.question_after, got.revision) == ("QUIZ_EM_ANDAMENTO", 1, 5)


MESSAGES = ["Olá", "menu", "resumo", "quiz", "3", "sair", "aprofundar", "outro tema", "mais curto", "A", "b", "não sei", "Quiz sobre x", "Resumo de y",
            "Informações sobre z", "um assunto qualquer", ""]
ANSWERS = [None, "ok", RETRY, "Correto. **Questão 2:** novo"]


def random_turns(n_sessions, n_turns, seed=3):
    rng = random.Random(seed)
    return [(f"s{s}", i, rng.choice(MESSAGES), rng.choice(ANSWERS), rng.random() < 0.1) for s in range(n_sessions) for i in range(n_turns + s)]


def by_turn(df):
    return sorted((r.session_id, r.turn, *r) for r in df.collect())


def test_blocks_do_not_change_the_result(spark):
    """One long session in many blocks equals the session in one piece, also from a stored and odd state."""
    turns = spark.createDataFrame(random_turns(6, 60), TURNS)
    states = spark.createDataFrame([("s1", "QUIZ_EM_ANDAMENTO", "info", "feridas", 2, 1, 40), ("s2", "LIVRE", "quiz", "", 3, 2, 7)], STATES)
    whole = by_turn(flow.fold_turns(turns, states, block_turns=10_000))
    assert whole == by_turn(flow.fold_turns(turns, states, block_turns=7))
    assert whole == by_turn(flow.fold_turns(turns, states, block_turns=1))
    assert len(whole) == turns.count()


def test_final_state_is_the_last_turn(spark):
    decisions = flow.fold_turns(spark.createDataFrame(random_turns(3, 10), TURNS))
    last = {r.session_id: r for r in sorted(decisions.collect(), key=lambda r: r.turn)}
    for s in flow.final_states(decisions).collect():
        assert (s.state, s.current_topic, s.revision) == (last[s.session_id].state_after, last[s.session_id].current_topic, last[s.session_id].revision)


def history(spark, *messages):
    return spark.createDataFrame([("s", i, r, c) for i, (r, c) in enumerate(messages)], "session_id string, turn long, role string, content string")


def test_inferred_state_keeps_the_topic(spark):
    h = history(
        spark, ("user", "Resumo sobre hemostasia"), ("assistant", "Resumo... Deseja aprofundar este tema, escolher outro tema ou encerrar?"),
        ("user", "Seja mais conciso"), ("assistant", "Versão curta... Deseja aprofundar este tema?"))
    got = flow.infer_state(h).first()
    assert (got.state, got.mode, got.current_topic) == ("RESUMO_CONCLUIDO", "resumo", "hemostasia")
    assert flow.last_topic(h).first().topic == "hemostasia"


def test_inferred_second_attempt_keeps_the_question(spark):
    got = flow.infer_state(history(
        spark, ("user", "Quiz sobre feridas"), ("assistant", "**Questão 1:** Enunciado"), ("user", "A"),
        ("assistant", "Correto. **Questão 2:** Novo enunciado"), ("user", "B"), ("assistant", RETRY))).first()
    assert tuple(got) == ("s", "QUIZ_SEGUNDA_TENTATIVA", "quiz", "feridas", 2, 2)


def test_inferred_default(spark):
    assert tuple(flow.infer_state(history(spark, ("user", "oi"))).first()) == ("s", "MENU_PRINCIPAL", "livre", "", 0, 0)


def test_request_validation(spark):
    uid = "123e4567-e89b-42d3-a456-426614174000"
    df = spark.createDataFrame(
        [(1, " s-1 ", uid, " oi "), (2, "s 1", uid, "oi"), (3, "s", "123e4567-e89b-72d3-a456-426614174000", "oi"), (4, "s", None, "x" * 8001),
         (5, "s", "", "x" * 8000), (6, "s", None, " \n"), (7, None, None, "oi"), (8, "a" * 129, None, "oi")],
        "n int, session_id string, request_id string, message string")
    got = {r.n: r.error_code for r in flow.validate_requests(df).collect()}
    assert {n for n, e in got.items() if e is None} == {1, 5}
    assert {r.n for r in flow.validate_requests(df, 3, 2000).collect() if r.error_code is None} == set()


def test_next_question(spark):
    df = spark.createDataFrame(
        [("simulado_respondendo", 1, "Correto!"), ("simulado_respondendo", 1, "QUESTÃO 2 : x"), ("simulado_respondendo", 1, RETRY), ("simulado_segunda_tentativa", 3, "fim"),
         ("livre", 1, "x"), ("simulado_respondendo", 0, "Questão 2: x")], "m string, q int, a string")
    got = [r.x for r in df.select(intents.next_question_missing("m", "q", "a").alias("x")).collect()]
    assert got == [True, False, False, False, False, False]


def test_invalid_transitions_across_days(spark):
    df = spark.createDataFrame(
        [("a", "s", "2024-01-01 23:59:00", "X", "Y"), ("b", "s", "2024-01-02 00:01:00", "Y", "Z"), ("c", "s", "2024-01-05 00:00:00", "Q", "Z"), ("d", "t", "2024-01-05 00:00:00", "Q", "Z")],
        "id string, session_id string, created_at string, state_before string, state_after string").withColumn("created_at", F.to_timestamp("created_at"))
    for rows in (1, 2, 100):
        assert [(r.id, r.previous_state) for r in sessions.invalid_transitions(df, rows).collect()] == [("c", "Z")]
