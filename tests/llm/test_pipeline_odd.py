"""The pipeline over odd rows: nulls, empty and long texts, repeated rows, clashing extra columns, and empty tables."""

from collections import Counter

import pytest
from odd import EXTRA, ROWS, documents

import corpus_pipeline

LABELS = [(1, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None), (9, 1, 0), (9, 0, 0), (10, 1, 0), (77, 1, 1)]


def folder(spark, path, rows, labels):
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    docs = documents(spark, rows)
    docs.write.parquet(str(path / "documents.parquet"))
    return str(path), docs


@pytest.mark.parametrize("labels", [LABELS, []])
def test_stages_keep_columns_and_make_up_no_rows(spark, tmp_path, labels):
    path, docs = folder(spark, tmp_path, ROWS, labels)
    columns, before = docs.columns, Counter((r["doc_id"], r["text"]) for r in docs.collect())
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stored(stage(spark, docs, path), name.replace(" ", "-"))
        if number == len(corpus_pipeline.STAGES) - 1:
            break
        assert docs.columns == columns and set(EXTRA) <= set(docs.columns)
        after = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        assert set(after) <= set(before)
        if name != "mixing sources to target weights":
            assert not after - before  # a row is dropped or stays as often as it was
        if name == "MinHash near-dedup":
            texts = [t or "" for _, t in after.elements()]
            assert len(texts) == len(set(texts))  # equal texts are one class
        before = after
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() == sum(before.values())


def test_empty_tables(spark, tmp_path):
    path, _ = folder(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, path).count() == 0
