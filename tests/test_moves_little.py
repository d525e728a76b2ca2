"""What upserts move and store, and how much a Python worker is given at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from lectern.operators import sync
from lectern.sources import sinks


def test_workers_get_long_texts_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("text"))
    assert max(r.n for r in texts.mapInArrow(sizes, "n long").collect()) < 5_000_000


def test_rows_without_repeats_are_not_moved(spark):
    new = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, content string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(sync.each_once(new))
    assert "SortMergeJoin" not in plan(sync.upsert_chunks(new, new))


def test_texts_are_stored_once(spark, tmp_path, monkeypatch):
    stored = []
    real = sinks.written
    monkeypatch.setattr(sinks, "written", lambda df, name: stored.append(df.columns) or real(df, name))
    row = lambda i, file, text: (str(i), file, text)
    schema = "id string, drive_file_id string, content string"
    first = spark.createDataFrame([row(1, "f1", "a"), row(2, "f1", "b"), row(3, "f2", "c")], schema)
    sinks.write_chunks(first, str(tmp_path / "t"), parts=4)
    second = spark.createDataFrame([row(2, "f1", "B"), row(4, "f3", "d")], schema)
    table = sinks.write_chunks(second, str(tmp_path / "t"), touched=second.select("drive_file_id"), parts=4)
    assert sorted((r.id, r.content) for r in table.collect()) == [("2", "B"), ("3", "c"), ("4", "d")]
    assert not [c for c in stored if "content" in c]
    assert not list((tmp_path / "t").glob("_aside*"))
