import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import vectors
from lectern.operators import references, retrieval

DOCS = "id string, source string, content string, embedding array<float>"


def vectors_table(spark, matrix, key="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], f"{key} long, embedding array<float>")


def brute_force(queries, docs, threshold, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore"):
        sims = np.round(unit(queries) @ unit(docs).T, 12)
    out = set()
    for q, row in enumerate(sims):
        order = sorted((-s, d) for d, s in enumerate(row) if s >= threshold)
        out |= {(q, d, r + 1) for r, (_, d) in enumerate(order[:k])}
    return out


@pytest.mark.parametrize("threshold", [-1.0, 0.2, 0.6, 0.95])
@pytest.mark.parametrize("options", [{}, dict(broadcast_values=1, cells=6, block_rows=40), dict(broadcast_values=1)])
# Expected strings below that come from the application are goldens: they must match to the letter.
def test_batch_is_exact_also_with_a_third_of_equal_vectors(spark, threshold, options):
    rng = np.random.default_rng(1)
    docs = rng.standard_normal((300, 8)).astype(np.float32)
    docs[100:200] = docs[0]  # copies: one hot cell, many ties
    docs[250] = 0
    queries = np.concatenate([docs[[0, 5, 120]], rng.standard_normal((60, 8)).astype(np.float32)])
    got = retrieval.match_batch(vectors_table(spark, queries, "query_id"), vectors_table(spark, docs), 8, 5, threshold, **options)
    assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == brute_force(queries.astype(float), docs.astype(float), threshold, 5)


def clusters(rng, count, each, dim, spread):
    centres = rng.standard_normal((count, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return (np.repeat(centres, each, axis=0) + spread * rng.standard_normal((count * each, dim))).astype(np.float32)


def test_few_documents_of_clusters_are_scored(spark):
    rng = np.random.default_rng(3)
    docs = clusters(rng, 40, 75, 16, 0.05)
    queries = docs[rng.permutation(len(docs))[:200]] + 0.02 * rng.standard_normal((200, 16)).astype(np.float32)
    asked = vectors_table(spark, queries, "query_id").withColumn("threshold", F.lit(-1.0))
    found, visited = retrieval.match_by_cells(asked, vectors_table(spark, docs), 16, 5, cells=60, block_rows=50)
    share = visited.agg(F.sum("documents")).first()[0] / (len(docs) * len(queries))
    assert share < 0.2 and visited.select("query_id").distinct().count() == 200
    best = retrieval.first_n_per_key(found, ["query_id"], [F.desc("similarity"), F.asc("id")], 5, "rank").collect()
    assert {(r.query_id, r.id, r["rank"]) for r in best} == brute_force(queries.astype(float), docs.astype(float), -1.0, 5)


def test_cells_cover_what_they_hold():
    rng = np.random.default_rng(4)
    units = vectors.unit_rows(clusters(rng, 7, 60, 6, 0.3).astype(float))
    tree = retrieval.CellTree(units[::3], 12)
    cell, angle, high = tree.place(units)
    for c in np.unique(cell):
        tree.cover(c, int((cell == c).sum()), angle[cell == c].max(), high[cell == c].max())
    asked = vectors.unit_rows(rng.standard_normal((50, 6)))
    for floor in (-1.0, 0.3, 0.9):
        q, c = tree.visits(asked, np.full(50, floor))
        visited = set(zip(q.tolist(), c.tolist()))
        hits = {(int(i), int(cell[j])) for i, j in zip(*np.nonzero(asked @ units.T >= floor))}
        assert hits <= visited and len(visited) == len(q)
    equal = retrieval.CellTree(np.tile(units[0], (9, 1)), 5)
    assert len(equal.centres) == 1


def test_threshold_is_inclusive_and_ties_go_by_id(spark):
    docs = spark.createDataFrame(
        [("b", "x", "c", [1.0, 0.0]), ("a", "x", "c", [2.0, 0.0]), ("c", "x", "c", [0.0, 1.0]), ("z", "x", "c", [0.0, 0.0]), ("n", "x", "c", None)], DOCS)
    got = retrieval.match_documents(docs, [1.0, 0.0], threshold=1.0, k=5).collect()
    assert [(r.id, r.similarity) for r in got] == [("a", 1.0), ("b", 1.0)]
    assert len(retrieval.match_documents(docs, [1.0, 0.0], threshold=-1.0, k=20).collect()) == 3


def test_pattern_filters_before_ranking(spark):
    docs = spark.createDataFrame([("a", "outra.pdf", "c", [1.0, 0.0]), ("b", "ADMINISTRATIVOxxplano_ensino_v2", "c", [0.1, 1.0])], DOCS)
    got = retrieval.match_documents(docs, [1.0, 0.0], -1.0, 1, source_pattern="administrativo__plano_ensino%").collect()
    assert [r.id for r in got] == ["b"]
    with pytest.raises(ValueError):
        retrieval.match_documents(docs, [1.0, 0.0], k=0)


def test_similarity_forms_agree(spark):
    a = spark.createDataFrame([([1.0, 2.0, 3.0],), ([0.0, 0.0, 0.0],)], "v array<float>")
    q = [3.0, 2.0, 1.0]
    rows = a.select(
        vectors.similarity_to("v", q).alias("x"), vectors.cosine_similarity("v", F.array(*[F.lit(x) for x in q]).cast("array<float>")).alias("y")).collect()
    assert rows[0].x == pytest.approx(10 / 14) and rows[0].y == pytest.approx(10 / 14)
    assert rows[1].x is None and rows[1].y is None


def test_embedding_keeps_order_and_fails_whole_batches():
    calls = []

    def short(texts, task):
        calls.append(task)
        return [[0.1, 0.2]]

    assert retrieval.embed_batch(["a"], short, "RETRIEVAL_QUERY", 2) == [[0.1, 0.2]]
    with pytest.raises(RuntimeError, match="EMBEDDING_COUNT_MISMATCH"):
        retrieval.embed_batch(["a", "b"], short, "RETRIEVAL_DOCUMENT", 2, sleep=lambda s: None)
    assert calls == ["RETRIEVAL_QUERY"] + ["RETRIEVAL_DOCUMENT"] * 3
    with pytest.raises(RuntimeError, match="EMBEDDING_DIMENSION_MISMATCH"):
        retrieval.embed_batch(["a"], short, "t", 3, sleep=lambda s: None)


def test_embedding_recovers():
    tries = []

    def flaky(texts, task):
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return [[float(len(t))] for t in texts]

    waits = []
    assert retrieval.embed_batch(["a", "bb"], flaky, "t", 1, sleep=waits.append) == [[1.0], [2.0]]
    assert waits == [2, 2]


def test_embed_stage(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 60)], "id int, content string")
    got = retrieval.embed(df, lambda texts, task: [[float(len(t)), float(len(texts) <= 7)] for t in texts], 2, batch=7).collect()
    assert all(list(r.embedding) == [float(r.id), 1.0] for r in got) and len(got) == 59


def test_grades(spark):
    matches = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "d")], "query_id int, id string")
    grades = spark.createDataFrame([(1, "a", "relevant"), (1, "b", "irrelevant"), (1, "c", None)], "query_id int, id string, grade string")
    assert sorted(r.id for r in retrieval.apply_grades(matches, grades, ["query_id", "id"]).collect()) == ["a", "c", "d"]


META = "struct<reference_author:string,reference_year:string,reference_title:string,reference_section:string>"


def finalized(spark, text, contents, mode, metadata=(None, None, None, None)):
    answers = spark.createDataFrame([(1, text, mode)], "query_id int, answer string, generation_mode string")
    chunks = spark.createDataFrame([(1, i + 1, c, metadata) for i, c in enumerate(contents)], f"query_id int, rank int, content string, metadata {META}")
    return references.finalize_references(answers, references.with_reference(chunks)).first().answer


def test_model_references_are_replaced(spark):
    cited = "Silva (2022). Cuidados perioperatórios em cirurgia geral. Capítulo 4, p. 45-52."
    got = finalized(
        spark, "Explicação breve.\n\nReferências: fonte inventada • Referência: outra fonte\n\nDeseja aprofundar este tema?",
        [cited, cited, "Plano de ensino sem metadados bibliográficos no trecho recuperado."], "resumo")
    assert got == ("Explicação breve.\n\nDeseja aprofundar este tema?\n\n**Referências:**\n"
                   "- Silva (2022) Cuidados perioperatórios em cirurgia geral. p. 45-52.")


def test_no_references_in_a_quiz(spark):
    assert "Referências" not in finalized(spark, "**Questão 1:**\n\n**A)** Uma", [None], "simulado_tema")


def test_chapter_title(spark):
    got = finalized(spark, "Resumo do conteúdo.", ["Capítulo 6 — Cuidados de Enfermagem no Pós-Operatório Imediato. A vigilância deve ser contínua."], "resumo")
    assert got.endswith("\n- Cuidados de Enfermagem no Pós-Operatório Imediato (Cap. 6).")


def test_title_above_authors(spark):
    text = "Intervenções fundamentais em cirurgia: diérese, hemostasia e síntese\nMedeiros AC, Dantas-Filho AM\nTexto do artigo."
    assert finalized(spark, "Resumo.", [text, "Trecho sem pista bibliográfica."], "resumo").endswith(
        "**Referências:**\n- Intervenções fundamentais em cirurgia: diérese, hemostasia e síntese.")


def test_stored_fields_win_and_fallback_is_single(spark):
    got = finalized(spark, "R.", ["qualquer"], "info", ("Silva", "2020", "Um título", "Cap. 2"))
    assert got == "R.\n\n**Referências:**\n- Silva (2020) Um título (Cap. 2)."
    assert finalized(spark, "R.", ["nada", None], "livre").count(references.NO_REFERENCE) == 1
    answers = spark.createDataFrame([(1, "R.", "livre")], "query_id int, answer string, generation_mode string")
    none = spark.createDataFrame([], "query_id int, rank int, reference string")
    assert references.finalize_references(answers, none).first().answer == f"R.\n\n**Referências:**\n- {references.NO_REFERENCE}"


def test_reference_metadata_reads_three_pages(spark):
    files = spark.createDataFrame(
        [("a", [(1, "capa"), (2, "x"), (3, "  Souza de Lima (2019). Cuidados em cirurgia segura. ")]), ("b", [(1, "c"), (2, "c"), (3, "c"), (4, "Souza (2019). Cuidados em cirurgia")]),
         ("c", [(1, "CAPÍTULO 3: Hemostasia e sutura. ")])],
        "file_id string, pages array<struct<page_number:int,text:string>>")
    got = {r.file_id: tuple(r.reference) if r.reference else None for r in references.extract_reference_metadata(files).collect()}
    assert got == {"a": ("Souza de Lima", "2019", "Cuidados em cirurgia segura", None), "b": None, "c": (None, None, "Hemostasia e sutura", "Cap. 3")}


def test_grading_keeps_matches_on_failure(spark):
    rows = [(i, f"q{i % 3}", "x" * 3000 if i == 4 else ("bad" if i % 2 else "good")) for i in range(10)]  # 4 makes the grader fail

    def grader(questions, passages):
        if any(len(p) == 2000 for p in passages):
            raise TimeoutError
        return ["relevant" if p == "good" else "irrelevant" for p in passages]

    matches = spark.createDataFrame(rows, "id int, question string, content string").coalesce(1)
    got = sorted(r.id for r in retrieval.grade(matches, grader, batch=1).collect())
    assert got == [0, 2, 4, 6, 8]


def test_a_vector_of_another_length_is_an_error(spark):
    docs = spark.createDataFrame([("1", [1.0, 0.0]), ("2", None), ("3", [1.0])], "id string, embedding array<float>")
    with pytest.raises(Exception, match="another length"):
        retrieval.match_documents(docs, [1.0, 0.0], 0.5, 2).collect()
    assert [r.id for r in retrieval.match_documents(docs.filter("id <> '3'"), [1.0, 0.0], 0.5, 2).collect()] == ["1"]
