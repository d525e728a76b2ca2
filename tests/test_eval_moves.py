"""Texts behind answers are not shuffled while they are short."""

from lectern.operators import quality


def test_texts_meet_entries_that_are_dealt_already(spark, monkeypatch):
    turns = spark.createDataFrame(
        [("s", "r1", [("d1",), ("d2",), ("source:x",)]), ("s", "r2", [("d2",)])], "session_id string, request_id string, retrieval array<struct<document_id:string>>")
    documents = spark.createDataFrame([("d1", "A", "one"), ("d2", "B", "two"), ("d3", "C", "three")], "id string, source string, content string")

    def made():
        df = quality.eval_material(quality.eval_context(turns, documents))
        plan = df._jdf.queryExecution().executedPlan().toString()
        return sorted(map(tuple, df.collect())), plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition"), plan.count("SortMergeJoin")

    rows, shuffles, merges = made()
    assert rows[1] == ("s", "r2", "[Fonte: B]\ntwo", 1) and rows[0][3] == 2
    assert (shuffles, merges) == (1, 0)
    monkeypatch.setattr(quality, "SENT_BYTES", 0)  # long texts are shuffled, with the same result
    assert made()[0] == rows
