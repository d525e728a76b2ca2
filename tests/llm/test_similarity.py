"""Near-duplicates of texts and vectors against brute force."""

import re
from collections import Counter

import numpy as np
from odd import ROWS, documents

from lectern.llm import bagminhash, metric_join
from lectern.llm.common import components


def classes_by_hand(rows):
    def bag(text):
        words = re.findall(r"\w+", text.lower())
        size = min(5, len(words))
        return Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) if words else Counter([("as it is", text)])

    bags, parent = [bag(t or "") for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = sum((bags[i] & bags[j]).values())
            if shared >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - shared):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[root(i)] = min(ids.get(root(i), doc_id), doc_id)
    return Counter((doc_id, ids.get(root(i))) for i, (doc_id, _) in enumerate(rows))


def chain(rng, n):
    """Texts of which each differs from the one before in two words: neighbours are alike, the ends are not."""
    words = [f"w{x}" for x in rng.integers(0, 10 ** 6, 200)]
    out = []
    for i in range(n):
        words[(7 * i) % 200] = f"n{i}"
        out.append(" ".join(words))
    return out


def test_near_duplicates_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, t) for i, t, _ in ROWS] + [(100 + i, t) for i, t in enumerate(chain(rng, 40))]
    rows += [(200 + i, "same text again and again for all of us " * 3) for i in range(30)]
    rows += [(300 + i, " ".join(f"r{x}" for x in rng.integers(0, 10 ** 6, 50))) for i in range(30)]
    docs = documents(spark, [(i, t, "s") for i, t in rows])
    got = bagminhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == classes_by_hand(rows)
    # one of each class stays, with the columns of the input
    kept = bagminhash.keep_first(docs, bagminhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({c for _, c in classes_by_hand(rows)})
    assert bagminhash.near_duplicates(documents(spark, [])).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    elements = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
    a = rng.integers(0, 9, 300)
    b = np.where(rng.random(300) < 0.6, a, rng.integers(0, 9, 300))
    owners = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    signed = bagminhash.signatures(owners, np.concatenate([elements[a > 0], elements[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((signed[0] == signed[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 4000)
    alone = bagminhash.signatures(np.zeros((a > 0).sum(), int), elements[a > 0], a[a > 0], 1, 4000)
    assert (alone[0] == signed[0]).all()


def test_occurrences_are_multisets():
    a = bagminhash.occurrences(np.array([1, 2], np.uint64), np.array([3, 1]))
    b = bagminhash.occurrences(np.array([1, 3], np.uint64), np.array([2, 5]))
    assert len(set(a.tolist())) == 4 and len(set(a.tolist()) & set(b.tolist())) == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (60, 40), (70, 70), (None, 3), (90, 91), (91, 90)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {40: 40, 50: 40, 60: 40, 70: 70, 90: 90, 91: 90}


def vectors_by_hand(rows):
    units = []
    for _, v, label in rows:
        ok = v and label is not None and None not in v and np.isfinite(v).all() and any(v)
        units.append(np.array(v) / np.linalg.norm(v) if ok else None)
    usable = [r[0] is not None and u is not None for r, u in zip(rows, units)]
    linked = [[j for j in range(len(rows)) if j != i and usable[i] and usable[j] and rows[i][2] == rows[j][2]
               and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93] for i in range(len(rows))]
    low = [r[0] for r in rows]
    while True:
        new = [min([low[i], *(low[j] for j in linked[i])]) if linked[i] else low[i] for i in range(len(rows))]
        if new == low:
            break
        low = new
    return Counter((r[0], len(linked[i]), low[i], r[0] is not None and r[0] == low[i]) for i, r in enumerate(rows))


def test_near_vectors_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(metric_join, "CELL", 40)
    monkeypatch.setattr(metric_join, "BLOCK", 16)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=8)).tolist(), i % 2) for i in range(150)]
    rows += [(200 + i, [1.0] * 8, 1) for i in range(40)]  # a group of copies
    rows += [(300 + i, (np.ones(8) + 0.01 * rng.normal(size=8)).tolist(), 1) for i in range(40)]  # of near copies
    rows += [(400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] * 8, 0), (403, [None] * 8, 0), (404, [], 0), (405, [1.0] * 8, None),
             (None, [1.0] * 8, 1), (406, [1.0] * 4, 1), (407, [2.0] * 8, 1), (200, [1.0] * 8, 1), (3, [5e-200] * 8, 0), (408, [1e200] * 8, 0)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, cell string, times int")
    got = metric_join.near_vectors(frame).collect()
    rows = [(i, [x * 1e200 for x in v] if i == 3 and v[0] == 5e-200 else [x * 1e-200 for x in v] if i == 408 else v, lab) for i, v, lab in rows]
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == vectors_by_hand(rows)
    assert metric_join.near_vectors(frame.limit(0)).count() == 0
