import io
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern import schemas
from lectern.operators import audit, dedup, metrics, sessions
from lectern.sources import files, sinks

UID = "123e4567-e89b-42d3-a456-426614174000"


@pytest.fixture
def long_session(spark):
    start = datetime(2024, 1, 1, 22)
    rows = [(f"{i:05d}", "hot", None, "user" if i % 2 == 0 else "assistant", f"m{i}", start + timedelta(minutes=i), None) for i in range(450)]
    return spark.createDataFrame(rows + [("x", "cold", None, "user", "só", start, None)], schemas.MESSAGES)


def test_dossier_parts_make_up_the_whole(long_session):
    got = audit.session_dossier(long_session, metrics.sessions(long_session), "TITULO", part_size=100)
    parts = [r.text for r in got.filter("session_id = 'hot'").orderBy("part").collect()]
    text = "".join(parts)
    assert len(parts) == 5 and text.count("[#") == 450 and text.startswith(audit.RULE + "\nTITULO\n")
    assert text.index("[#99] ") < text.index("[#100] ") < text.index("[#101] ") and "Total Interações: 450" in parts[0]
    assert "[#1] ESTUDANTE (22:00:00):\nm0\n" in parts[0] and "[#2] TUTOR DE ENFERMAGEM (22:01:00):\nm1\n" in parts[0]


def test_audit_export(spark, long_session, tmp_path):
    sinks.export_audit_json(long_session, str(tmp_path / "audit"), part_size=200)
    got = spark.read.json(str(tmp_path / "audit"))
    assert got.count() == 4 and got.select(F.sum(F.size("messages"))).first()[0] == 451
    assert audit.audit_summary(long_session).first().sessions == 2
    assert audit.audit_window(long_session, "2024-01-01 22:01:00", "2024-01-01 22:03:00").count() == 3
    with pytest.raises(Exception):
        audit.audit_window(long_session, "2024-01-02 00:00:00", "2024-01-01 00:00:00").count()


def test_report(spark, long_session):
    rows = metrics.sessions(long_session).withColumn("avg_rating", F.when(F.col("session_id") == "hot", 4.25).cast("double"))
    got = audit.session_report(rows).orderBy("number").collect()
    assert [(r.label, r.session_id, r.rating, r.first_message) for r in got] == [("#01", "hot", "4.3", "m0"), ("#02", "cold", "—", "só")]


CASE = schemas.ACCEPTANCE_CASES


def test_acceptance(spark, tmp_path):
    (tmp_path / "cases.json").write_text("""[
      {"id": "1", "description": "d", "messages": ["m"], "expect": {"includes": ["Qual TEMA"], "excludes": ["erro"], "sourcesMin": 1, "maxLatencyMs": 100}},
      {"id": "2", "description": "d", "messages": ["m"], "expect": {"includes": ["abc"], "sourcesMin": 0, "maxLatencyMs": 100}},
      {"id": "3", "description": "d", "messages": ["m"], "expect": {"includes": [], "sourcesMin": 0, "maxLatencyMs": 100}}
    ]""")
    cases = files.read_acceptance_cases(spark, str(tmp_path / "cases.json"))
    results = spark.createDataFrame([("1", 200, "qual tema?", 1, 100), ("2", 500, "um ERRO", None, 101)], "id string, status int, answer string, sources_found int, elapsed_ms int")
    checked = audit.check_answers(results, cases)
    got = {r.id: list(r.failures) for r in checked.collect()}
    assert got == {"1": [], "2": ["HTTP 500", 'não contém "abc"', "latência 101ms > 100ms"], "3": ["HTTP ?"]}
    assert tuple(audit.acceptance_summary(checked).first()) == (1, 2, 3)
    before = spark.createDataFrame([("1", False), ("2", True), ("9", True)], "id string, passed boolean")
    assert {r.id: r.change for r in audit.regression_diff(before, checked).collect()} == {"1": "fixed", "2": "broken", "3": "added", "9": "dropped"}


def docx(*paragraphs):
    body = "".join(f"<w:p>{''.join(f'<w:r><w:t>{r}</w:t></w:r>' for r in p)}</w:p>" for p in paragraphs)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return data.getvalue()


def test_extraction(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.DOCX").write_bytes(docx(["Olá ", "mundo"], [" "], ["fim"]))
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.pdf").write_bytes(b"one\f \fthree")
    (tmp_path / "d.txt").write_bytes(b"no")
    found = files.scan_files(spark, str(tmp_path), files.RICH_TYPES)
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.select("path").collect()) == ["a.DOCX", "b.docx", "c.pdf"]
    assert files.scan_files(spark, str(tmp_path), files.RICH_TYPES, recursive=False).count() == 2
    out = files.extract_routed(found, "path", {"docx": files.docx_pages, "pdf": lambda b: b.decode().split("\f")})
    got = {r.path.rsplit("/", 1)[1]: [tuple(p) for p in r.pages] for r in out.collect()}
    assert got == {"a.DOCX": [(1, "Olá mundo\n\nfim")], "b.docx": [], "c.pdf": [(1, "one"), (3, "three")]}
    pages = files.explode_pages(out.withColumn("file_id", F.col("path")), ["file_id"])
    missing = files.unsupported_files(out.withColumn("file_id", F.col("path")), pages).collect()
    assert [r.file_id.rsplit("/", 1)[1] for r in missing] == ["b.docx"] and missing[0].status == "unsupported"
    failed = files.extract_pages(found, lambda b: 1 / 0).first()
    assert list(failed.pages) == [] and "ZeroDivisionError" in failed.extract_error


NODES = "id string, parent string, name string, mime_type string, trashed boolean"
PDF = "application/pdf"


def test_folder_tree(spark):
    folder = files.FOLDER_TYPE
    nodes = spark.createDataFrame(
        [("sub", "top", "Sub", folder, False), ("a", "top", "A", PDF, False), ("b", "top", "B", "image/png", False), ("c", "sub", "C", files.REMOTE_TYPES[2], False),
         ("gone", "sub", "D", PDF, True), ("bin", "top", "Bin", folder, True), ("e", "bin", "E", PDF, False), ("top", "sub", "loop", folder, False)], NODES)
    got = {r.id: r.drive_path for r in files.folder_paths(nodes, "top").collect()}
    assert got == {"a": "ROOT/A", "c": "ROOT/Sub/C"}


def test_a_deep_tree_and_a_cycle_below_the_root(spark):
    deep = [(f"n{i}", f"n{i - 1}" if i else "top", f"n{i}", files.FOLDER_TYPE, False) for i in range(30)]
    cycle = [("p", "q", "p", files.FOLDER_TYPE, False), ("q", "p", "q", files.FOLDER_TYPE, False), ("p", "top", "p", files.FOLDER_TYPE, False)]
    nodes = spark.createDataFrame(deep + cycle + [("f", "n29", "f", PDF, False), ("g", "q", "g", PDF, False)], NODES)
    got = {r.id: r.drive_path for r in files.folder_paths(nodes, "top").collect()}
    assert got.keys() == {"f", "g"} and got["f"].count("/") == 31 and got["g"] == "ROOT/p/q/g"


def test_a_file_without_extractor_is_an_error_row(spark):
    found = spark.createDataFrame([("a.docx", b"x"), ("b.pdf", b"y"), ("c.pdf", b"broken")], "path string, content binary")

    def read(data):
        return [data.decode()] if data != b"broken" else 1 / 0

    got = {r.path: (len(r.pages), r.extract_error) for r in files.extract_routed(found, "path", {"pdf": read}).collect()}
    assert got["b.pdf"] == (1, None) and got["c.pdf"][0] == 0 and "ZeroDivisionError" in got["c.pdf"][1] and "no extractor" in got["a.docx"][1]
    bulk = {r.path: r.extract_error for r in files.extract_routed(found, "path", {"light": read, "structured": read}, bulk=True).collect()}
    assert bulk == {"a.docx": None, "b.pdf": None, "c.pdf": None}


def test_turn_deduplication(spark):
    rows = [("2", "s", UID, "user", "second", 2), ("1", "s", UID, "user", "first", 1), ("3", "s", UID, "assistant", "a", 1), ("4", "s", None, "user", "n", 1), ("5", "s", None, "user", "n", 1)]
    df = spark.createDataFrame(rows, "id string, session_id string, request_id string, role string, content string, created_at int")
    assert sorted(r.id for r in dedup.dedup_turns(df).collect()) == ["1", "3", "4", "5"]


def test_histories(spark, long_session):
    newest = sessions.recent_history(long_session, 20).filter("session_id = 'hot'").orderBy("position").collect()
    assert [r.content for r in newest] == [f"m{i}" for i in range(449, 429, -1)]
    oldest = sessions.session_history(long_session, 50).filter("session_id = 'hot'").orderBy("position").collect()
    assert [r.content for r in oldest] == [f"m{i}" for i in range(50)]
    with_system = long_session.withColumn("role", F.when(F.col("content") == "m449", "system").otherwise(F.col("role")))
    assert sessions.recent_history(with_system, 20).filter("session_id = 'hot'").count() == 19


def test_upsert_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, content string")
    path = str(tmp_path / "t")
    sinks.write_chunks(df, path)
    newer = spark.createDataFrame([("2", "B"), ("3", "c")], "id string, content string")
    once = sorted(map(tuple, sinks.write_chunks(newer, path).collect()))
    assert once == sorted(map(tuple, sinks.write_chunks(newer, path).collect())) == [("1", "a"), ("2", "B"), ("3", "c")]
