"""Questions are compared with cells a bounded number of pairs at a time."""

import random

from lectern.operators import retrieval


def test_slices_of_a_batch_give_the_same_matches(spark, monkeypatch):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)], "id long, embedding array<float>").coalesce(1)
    questions = docs.selectExpr("id as query_id", "embedding").limit(90)
    plain = sorted(map(tuple, retrieval.match_batch(questions, docs, 8, threshold=0.1).collect()))
    monkeypatch.setattr(retrieval, "PAIRS", 36)  # three questions of twelve cells
    assert retrieval._TopK.CELLS <= 1_000_000
    cells = retrieval.match_batch(questions, docs, 8, threshold=0.1, broadcast_values=8, cells=12)
    assert sorted(map(tuple, cells.collect())) == plain
