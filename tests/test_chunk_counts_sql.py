"""The SQL count of chunks against the splitter, and that the manifest's check compares counts."""

import random

import duckdb
import pandas as pd

import __spark_entry__ as entry
from lectern.operators.chunking import split_text
from lectern.plans.corpus_queries import chunk_counts_sql


def test_counts_of_odd_texts():
    rng = random.Random(1)
    parts = ["a", "bcd", " ", ". ", "\n", "\n\n", "x" * 999, "y" * 1000, " ", ".", "é" * 1400]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))).strip() for _ in range(300)]
    pages = pd.DataFrame([(i, "1", t) for i, t in enumerate(texts) if t], columns=["file_id", "path", "text"])
    con = duckdb.connect()
    con.register("pages", pages)
    got = dict(con.execute("with one as (select 1)" + chunk_counts_sql("pages") + " select file_id, chunks from counts").fetchall())
    assert got == {i: len(split_text(t, 1000, 0)) for i, _, t in pages.itertuples(index=False)}


def test_the_manifest_is_checked_by_counts():
    assert "chunks_count > 0" not in entry.oracle_sql()["e_reconcile_manifest"]
