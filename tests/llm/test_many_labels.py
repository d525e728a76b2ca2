"""Labels may be many: only the larger ones need pivots."""

from collections import Counter

import numpy as np
import pytest
from test_similarity import vectors_by_hand

from lectern.llm import metric_join


def check(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = metric_join.near_vectors(frame).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == vectors_by_hand(rows)


def near(rng, centres, n, label, start):
    return [(start + i, (centres[i % len(centres)] + 0.2 * rng.normal(size=len(centres[0]))).tolist(), label) for i in range(n)]


@pytest.mark.parametrize("sizes", [
    [1, 2, 3, 5] * 5 + [150, 41],  # more small labels than pivots, and two that are divided
    [50] * 6 + [200],  # more labels above CELL than half of the pivots
    [3] * 12,  # none is divided
])
def test_more_labels_than_pivots(spark, monkeypatch, sizes):
    monkeypatch.setattr(metric_join, "CELL", 40)
    monkeypatch.setattr(metric_join, "BLOCK", 16)
    monkeypatch.setattr(metric_join, "MOST_PIVOTS", 8)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 8))
    rows = []
    for label, n in enumerate(sizes):
        rows += near(rng, centres, n, label, len(rows))
    rows += [(len(rows), [1.0] * 4, 0), (len(rows) + 1, [2.0] * 4, 0), (len(rows) + 2, [1.0] * 8, None)]  # another length, no label
    check(spark, rows)


def test_pivots_stay_within_their_bound(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL", 40)
    monkeypatch.setattr(metric_join, "MOST_PIVOTS", 8)
    for counts in ([41] * 3, [41] * 4, [41] * 9, [41, 1000], [81] * 4 + [500], [500] * 20, [10] * 100):
        sizes = spark.createDataFrame([(i, 8, n) for i, n in enumerate(counts)], "label int, size int, n bigint")
        width = metric_join._width(sizes)
        assert width >= 40 and sum(-(-n // width) for n in counts if n > width) <= 8


def test_three_thousand_labels(spark):
    rng = np.random.default_rng(6)
    rows = [(2 * i + j, v, i) for i in range(3000) for v in [rng.normal(size=4).tolist()] for j in range(2)]
    got = metric_join.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    assert Counter((r["n_links"], r["component_id"] == r["vec_id"] - r["vec_id"] % 2) for r in got.collect()) == {(1, True): 6000}
