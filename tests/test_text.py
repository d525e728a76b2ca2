import uuid

from pyspark.sql import functions as F

from lectern.functions import identity, intents, text


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn("v").alias("o")).first()["o"]


def test_sanitize_removes_nul(spark):
    assert one(spark, "hemo\0stasia", text.sanitize) == "hemostasia"
    assert one(spark, "fonte\0.pdf", text.sanitize) == "fonte.pdf"


def test_blank_lines(spark):
    assert one(spark, "  a \n\n\t b\r\n \n c", text.strip_blank_lines) == "a\nb\nc"


def test_normalize_input(spark):
    assert one(spark, "  Olá,  TUTOR! Ação_1 é-isso? ", text.normalize_input) == "ola tutor acao_1 e-isso"
    assert one(spark, "é Ñandú Ǻ", text.normalize_input) == "e nandu a"
    assert one(spark, "???", text.normalize_input) == ""


def test_plain_text(spark):
    markdown = "**Olá** 😀 `código` [link](http://x.y) 12345 e 123\n\nFim # 2024-20250\n```x\ny```ok"
    assert one(spark, markdown, text.plain_text) == "Olá   link 1 2 3 4 5 e 123. Fim  2 0 2 4-2 0 2 5 0\nok"
    assert one(spark, "a12345 12345b 1234", text.plain_text) == "a12345 12345b 1 2 3 4"


def test_answer_layout(spark):
    got = one(spark, "Qual? A) um **B)** dois C) três D) quatro", text.normalize_answer_layout)
    assert got == "Qual?\n\n**A)** um\n\n**B)** dois\n\n**C)** três\n\n**D)** quatro"
    assert one(spark, "A) um B) dois", text.normalize_answer_layout) == "A) um B) dois"
    got = one(spark, "Texto Referências: • Referência: um • Referência: dois", text.normalize_answer_layout)
    assert got == "Texto **Referências:**\n\n- Referência: um\n- Referência: dois"


def test_uuid5(spark):
    for value in ["abc", "é ü 😀", "f:1:0:" + "a" * 64, ""]:
        assert one(spark, value, lambda c: identity.uuid5(uuid.NAMESPACE_URL, c)) == str(uuid.uuid5(uuid.NAMESPACE_URL, value))
        assert one(spark, value, identity.normalize_session_id) == str(uuid.uuid5(uuid.NAMESPACE_DNS, value))
    known = str(uuid.uuid4())
    assert one(spark, known, identity.normalize_session_id) == known


def test_chunk_ids_are_stable_and_keep_their_file(spark):
    df = spark.createDataFrame([("file-a", 1, 0), ("file-a", 1, 0), ("file-b", 1, 0), ("file-a", 2, 5)], "f string, p int, i int")
    ids = [r[0] for r in df.select(identity.chunk_record_id("f", "p", "i", F.lit("hash"))).collect()]
    assert ids[0] == ids[1] == str(uuid.uuid5(uuid.NAMESPACE_URL, "file-a:1:0:hash"))
    assert len(set(ids)) == 3


def test_intents(spark):
    cases = {
        "": "greeting", "Olá": "greeting", "bom dia tutor": "greeting", "Menu": "menu_return", "quero voltar pro menu já": "menu_return",
        "Voltar ao menu principal": "menu_return", "Resumo de Conteúdo": "menu_resumo", "opção 2": "menu_quiz", "3": "menu_info",
        "Encerrar Sessão": "farewell", "Aprofundar": "aprofundar", "Escolher outro tema": "outro_tema", "Seja mais conciso": "reformular_conciso",
        "O que é hemostasia e como o tutor explica?": "content",
    }
    df = spark.createDataFrame(list(cases.items()), "m string, want string")
    assert [r for r in df.select("m", "want", intents.detect_intent("m").alias("got")).collect() if r.want != r.got] == []


def test_legacy_intents_match_inside_words(spark):
    df = spark.createDataFrame([("enfim, isso",), ("Olá, tudo bem?",), ("Início",), ("hemostasia",), ("",)], "m string")
    got = [tuple(r.i) for r in df.select(intents.legacy_intents("m").alias("i")).collect()]
    assert got == [(True, False, False), (False, False, True), (False, True, False), (False, False, False), (False, False, False)]


def test_inline_requests(spark):
    cases = [
        ("Resumo sobre hemostasia", ("resumo", "hemostasia")),
        ("Quero um resumo de Conteúdo sobre Cuidados Pós-Operatórios", ("resumo", "Cuidados Pós-Operatórios")),
        ("Quiz sobre feridas", ("quiz", "feridas")),
        ("Informações sobre critérios de avaliação", ("info", "critérios de avaliação")),
        ("o que é um quiz", None),
    ]
    df = spark.createDataFrame([(m,) for m, _ in cases], "m string")
    got = [tuple(r.i) if r.i else None for r in df.select(intents.extract_inline("m").alias("i")).collect()]
    assert got == [want for _, want in cases]


def test_threshold_routes(spark):
    df = spark.createDataFrame([("info", "x"), ("livre", "Qual o HORÁRIO?"), ("resumo", "hemostasia")], "mode string, q string")
    got = [tuple(r.r) for r in df.select(intents.route_threshold(F.col("mode"), F.col("q")).alias("r")).collect()]
    assert got == [(-1.0, intents.PLAN_PATTERN), (0.25, None), (0.35, None)]
