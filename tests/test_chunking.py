import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from lectern.operators import chunking
from lectern.operators.chunking import heading_chunks, page_line_chunks, split_text

PAGES = "file_id string, source string, pages array<struct<page_number:int,text:string>>"


def test_short_text_is_one_chunk():
    assert split_text("um texto curto") == ["um texto curto"]


def test_paragraphs_first_then_finer_separators():
    text = "a" * 300 + "\n\n" + "b" * 300 + "\n\n" + "c" * 300
    assert split_text(text, 700, 0) == ["a" * 300 + "\n\n" + "b" * 300, "c" * 300]
    sentences = ". ".join(["x" * 150] * 4)
    assert split_text(sentences, 400, 0) == ["x" * 150 + ". " + "x" * 150, ". " + "x" * 150 + ". " + "x" * 150]


def test_characters_with_overlap():
    text = "".join(chr(97 + i % 26) for i in range(500))
    parts = split_text(text, 200, 50)
    assert parts == [text[0:200], text[150:350], text[300:500]]


def test_words_overlap():
    words = " ".join(f"w{i:03d}" for i in range(100))
    parts = split_text(words, 200, 30)
    assert all(len(p) <= 200 for p in parts)
    assert parts[1].split()[0] in parts[0].split()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=1500), st.integers(200, 400), st.integers(0, 100))
def test_chunks_stay_within_size_and_lose_no_letter(text, size, overlap):
    parts = split_text(text, size, overlap)
    # a piece of exactly the size limit is passed on to finer separators
    assert all(len(p) <= size for p in parts)
    if overlap == 0:
        letters = lambda s: "".join(c for c in s if c in "ab")
        assert letters("".join(parts)) == letters(text)


def test_argument_ranges(spark):
    files = spark.createDataFrame([], PAGES)
    for size, overlap in [(100, 0), (5000, 0), (1000, 501), (200, 200)]:
        with pytest.raises(ValueError):
            chunking.chunk_recursive(files, size, overlap)


def test_chunk_index_runs_over_pages(spark):
    pages = [(1, "p1 " + "x " * 300), (2, "  "), (3, "hemo\0stasia"), (7, "fim")]
    got = chunking.chunk_recursive(spark.createDataFrame([("f", "fonte\0.pdf", pages)], PAGES), 200, 20).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got)))
    assert [r.page_number for r in got][-2:] == [3, 7]
    assert got[-2].content == "hemostasia" and got[0].source == "fonte.pdf"
    assert all(r.content_hash == hashlib.sha256(r.content.encode()).hexdigest() for r in got)


def test_headings():
    body = "linha " * 20
    text = f"intro {body}\n# Um\n{body}\n\n## Dois\ncurto\n# Tres\n{body}\n{body}"
    got = heading_chunks(text, 200, 80)
    b = body.strip()
    assert got == [f"intro {b}", f"Um\n{b}", f"Tres\n{b}", f"Tres\n{b}"]


def test_heading_hash_covers_heading(spark):
    df = spark.createDataFrame([("f", "s.docx", "# Título\n" + "palavra " * 20)], "file_id string, source string, text string")
    row = chunking.chunk_by_heading(df).first()
    assert row.content.startswith("Título\n") and row.content_hash == hashlib.sha256(row.content.encode()).hexdigest()


def test_page_lines_accumulate_over_pages():
    line = "x" * 90
    got = page_line_chunks([line, "", None, f"{line}\n\n{line}", "y" * 100], 200, 80)
    assert got == [(2, f"{line}\n{line}"), (3, f"{line}\n{'y' * 100}")]


def test_page_mark_is_not_hashed(spark):
    df = spark.createDataFrame([("f", "s.pdf", [(1, "z" * 100)])], PAGES)
    row = chunking.chunk_by_page_lines(df).first()
    assert row.content == "[Pág. 1] " + "z" * 100 and row.content_hash == hashlib.sha256(b"z" * 100).hexdigest()
