"""Questions and documents are copied once for each block they meet, not for each cell."""

import numpy as np
import pytest

from lectern.functions.vectors import unit_rows
from lectern.operators import retrieval


def table(spark, matrix, key, name=int):
    return spark.createDataFrame([(name(i), [float(x) for x in v]) for i, v in enumerate(matrix)], f"{key} {'string' if name is str else 'long'}, embedding array<float>")


def moved(spark):
    """Rows written to shuffles so far."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    context.listenerBus().waitUntilEmpty()
    none = gateway.jvm.java.util.ArrayList
    stages = context.statusStore().stageList(none(), False, False, gateway.new_array(gateway.jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def expected(queries, docs, threshold, k, name=int):
    sims = np.round(unit_rows(queries.astype(float)) @ unit_rows(docs.astype(float)).T, 12)
    out = set()
    for q, row in enumerate(sims):
        best = sorted((-s, name(d)) for d, s in enumerate(row) if s >= threshold)
        out |= {(name(q), d, r + 1) for r, (_, d) in enumerate(best[:k])}
    return out


@pytest.mark.parametrize("options", [dict(cells=24), dict(cells=60, block_rows=300)])
def test_copies_do_not_grow_with_cells(spark, monkeypatch, options):
    stored, real = [], retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, name: stored.append(real(df, name)) or stored[-1])
    vectors = np.random.default_rng(8).standard_normal((600, 16)).astype(np.float32)
    before = moved(spark)
    got = retrieval.match_batch(table(spark, vectors, "query_id"), table(spark, vectors, "id"), 16, 1, 0.1, broadcast_values=1, **options).collect()
    assert moved(spark) - before < 12 * 600
    assert sum(t.count() for t in stored if "embedding" in t.columns) <= 3 * 600
    assert {(r.query_id, r.id, r["rank"]) for r in got} == expected(vectors, vectors, 0.1, 1)


@pytest.mark.parametrize("name", [int, str])
def test_many_small_blocks_of_odd_vectors(spark, monkeypatch, name):
    monkeypatch.setattr(retrieval, "BLOCK_VALUES", 30 * 8)
    rng = np.random.default_rng(9)
    docs = rng.standard_normal((400, 8)).astype(np.float32)
    docs[50:180] = docs[7]  # one cell in several blocks, all of it ties
    docs[[3, 260]] = 0
    queries = docs[rng.permutation(400)[:150]]
    got = retrieval.match_batch(
        table(spark, queries, "query_id", name), table(spark, docs, "id", name), 8, 3, -0.2, broadcast_values=1, cells=20, block_rows=10)
    assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == expected(queries, docs, -0.2, 3, name)


def test_blocks_fill_memory_before_they_grow_in_number():
    assert retrieval._block_counts(718_000, 718_000, 20_000, 93_750, 48) == (8, 8)
    assert retrieval._block_counts(120_000, 120_000, 20_000, 93_750, 48) == (6, 6)
    assert retrieval._block_counts(5_000, 10_000_000, 20_000, 93_750, 48) == (1, 107)
    assert retrieval._block_counts(0, 1, 20_000, 93_750, 48) == (1, 1)


@pytest.mark.parametrize("threshold", [-1.0, 0.3])
@pytest.mark.parametrize("copies", [0, 900])
def test_single_precision_loses_no_document(threshold, copies):
    rng = np.random.default_rng(10)
    docs, queries = rng.standard_normal((3_000, 12)), rng.standard_normal((40, 12))
    docs[:copies] = docs[0]
    docs[1_000:1_200] = docs[1_000] + 1e-9 * rng.standard_normal((200, 12))  # equal in single precision
    docs[[5, 2_500]], queries[3] = 0, 0
    queries[4], queries[5] = docs[1_000], docs[0] + 1e-9
    ids, order = rng.permutation(3_000), rng.permutation(3_000)
    best = retrieval._TopK(unit_rows(queries), np.full(40, threshold), 4)
    for at in range(0, 3_000, 700):
        some = order[at:at + 700]
        best.add(ids[some], unit_rows(docs[some]), np.arange(40)[::-1] if at else None)
    got = best.rows(retrieval.pa.array(range(40)), retrieval.pa.int64()).to_pylist()
    by_id = np.empty_like(docs)
    by_id[ids] = docs
    assert {(r["query_id"], r["id"]) for r in got} == {(q, d) for q, d, _ in expected(queries, by_id, threshold, 4)}
