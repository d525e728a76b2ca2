"""Importance resampling, exact duplicates against an index and hard negatives, against brute force and over odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd import EXTRA, ROWS, documents

from lectern.llm import exact_dedup, hard_negatives, importance
from lectern.session import scratch_path

# ---- op11


def resampled_by_hand(rows, targets, percent=25, least=20):
    def words(text):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    def buckets(text):
        w = words(text)
        return [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    s, t = Counter(), Counter()
    for text in rows:
        s.update(buckets(text[1]))
    for text in targets:
        t.update(buckets(text))
    totals = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (totals[0] + 10_000)) / ((s[b] + 1) * (totals[1] + 10_000)))) for b in s}
    out = []
    for doc_id, text in rows:
        own = buckets(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(own), weight, score, len(words(text))))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = able[:len(able) * percent // 100]
    result = Counter((*r[:4], i + 1) for i, r in enumerate(drawn))
    return result + Counter((*r[:4], None) for r in (Counter(out) - Counter(drawn)).elements())


def target_table(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id bigint, text string, bucket string")


def test_resampling_by_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, t) for i, t, _ in ROWS]
    rows += [(100 + i, " ".join(f"Wort{x}" for x in rng.integers(0, 60, 15 + i % 40))) for i in range(120)]
    rows += [(50, "the same text again, of more than twenty words " * 3)] * 7 + [(None, "tie " * 30)] * 5 + [(None, "tie " * 31)] * 2
    rows += [(60, "y" * 80 + " " + "z" * 63 + " " + "ä" * 40 + " ÀÉ x1y2 " + "w " * 20), (61, "x" * 3_000_000 + " a" * 20)]
    targets = ["wort1 wort2 wort3 WORT4", None, "", "y" * 80 + " " + "z" * 63]
    docs = documents(spark, [(i, t, "s") for i, t in rows])
    got = importance.resample(docs, target_table(spark, targets))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == resampled_by_hand(rows, targets)
    half = importance.resample(docs, target_table(spark, targets), percent=60, least_words=1)
    assert Counter(map(tuple, half.collect())) == resampled_by_hand(rows, targets, 60, 1)
    taken = importance.take(docs, got)
    assert taken.columns == docs.columns
    wanted = {r["doc_id"] for r in got.collect() if r["rank"] is not None}
    assert Counter(r["doc_id"] for r in taken.collect()) == Counter(i for i, _ in rows if i in wanted)


def test_resampling_of_empty_tables(spark):
    docs = documents(spark)
    assert importance.resample(documents(spark, []), target_table(spark, ["a"])).count() == 0
    rows = [(i, t) for i, t, _ in ROWS]
    assert Counter(map(tuple, importance.resample(docs, target_table(spark, [])).collect())) == resampled_by_hand(rows, [])
    with pytest.raises(ValueError):
        importance.resample(docs, docs, percent=101)
    none = importance.resample(docs, target_table(spark, ["a"]), percent=0).collect()
    assert len(none) == len(rows) and not any(r["rank"] for r in none)


@pytest.mark.parametrize("k", [1, 2, 50, 499, 500])
def test_bracket_holds_the_cutoff(spark, k):
    rng = np.random.default_rng(3)
    scores = sorted((rng.normal(size=300) * 1000).astype(int).tolist() + [17] * 200, reverse=True)
    rows = spark.createDataFrame([(x,) for x in scores], "score bigint")
    # a sketch as coarse as can be must be widened until it is right
    for accuracy in (2, 100):
        low, high, above = importance.bracket(rows, k, accuracy)
        assert above == sum(x > high for x in scores) and above < k and low <= scores[k - 1] <= high


def test_feature_hashes_forget():
    hashes = importance.FeatureHashes(memory=1000)
    texts = [b"alpha beta  Gamma-delta", b"", b"alpha", "größe 1 ".encode() * 50, b"q" * 100 + b" alpha"]
    for _ in range(3):
        words, counts, pairs, pair_counts = hashes(texts)
        assert counts.tolist() == [4, 0, 1, 100, 2] and pair_counts.tolist() == [3, 0, 0, 99, 1]
        assert words[:4].tolist() == [zlib.crc32(w) for w in (b"alpha", b"beta", b"gamma", b"delta")]
        assert pairs[:3].tolist() == [zlib.crc32(w) for w in (b"alpha beta", b"beta gamma", b"gamma delta")]
        assert pairs[-1] == zlib.crc32(b"q" * 100 + b" alpha")


# ---- op12


def groups_by_hand(rows):
    def key(text):
        return hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest()

    ids, sizes = defaultdict(list), Counter(key(t) for _, t in rows)
    for i, t in rows:
        ids[key(t)] += [] if i is None else [i]
    keep = {k: min(x, default=None) for k, x in ids.items()}
    return Counter((i, keep[key(t)], sizes[key(t)], i == keep[key(t)], key(t)) for i, t in rows)


DUPLICATES = [(i, t) for i, t, _ in ROWS] + [
    (30, "a \t\n b"), (20, "a b"), (25, "a\vb"), (21, " a b"), (22, "a b "), (23, "a b"), (24, "a　b"), (None, "a  b"), (-5, ""), (31, None)]


def test_exact_duplicates_by_hand(spark):
    docs = documents(spark, [(i, t, "s") for i, t in DUPLICATES])
    got = exact_dedup.deduplicate(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == groups_by_hand(DUPLICATES)
    one = exact_dedup.unique_documents(docs, got)
    assert one.columns == docs.columns and set(EXTRA) <= set(one.columns)
    assert Counter(r["doc_id"] for r in one.collect()) == Counter(k[1] for k in {(s, keep) for _, keep, _, _, s in groups_by_hand(DUPLICATES)})
    assert exact_dedup.deduplicate(documents(spark, [])).count() == 0
    no_ids = exact_dedup.deduplicate(documents(spark, [(None, "x", "s"), (None, "x", "s"), (None, None, "s")]))
    assert Counter((r["keep_id"], r["group_size"], r["kept"]) for r in no_ids.collect()) == {(None, 2, True): 2, (None, 1, True): 1}
    assert exact_dedup.unique_documents(documents(spark, [(None, "x", "s"), (None, "x", "s"), (None, None, "s")]), no_ids).count() == 2


def test_index_keeps_what_came_first(spark):
    path = scratch_path(spark, "index")
    index = exact_dedup.DigestIndex(spark, "index_of_test", path, 4)
    first = documents(spark, [(10, "one", "s"), (11, "two", "s"), (12, "one", "s")])
    second = documents(spark, [(1, "one", "s"), (2, "three", "s"), (3, "three", "s"), (4, None, "s")])
    keeps = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.deduplicate(first, index).collect()}
    assert keeps == {10: (10, 2, True), 11: (11, 1, True), 12: (10, 2, False)}
    for _ in range(2):  # a batch that is added again changes nothing
        keeps = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.deduplicate(second, index).collect()}
        assert keeps == {1: (10, 1, False), 2: (2, 2, True), 3: (2, 2, False), 4: (4, 1, True)}
        assert index.read().count() == 4
    # another session opens it by its path
    index.drop()
    again = exact_dedup.DigestIndex(spark, "index_of_test_again", path, 4)
    assert again.read().count() == 4
    compact = again.compact(scratch_path(spark, "index"))
    assert Counter(map(tuple, compact.read().collect())) == Counter(map(tuple, again.read().collect()))
    assert len(compact.read().inputFiles()) <= 4
    again.drop()
    compact.drop()


def test_index_is_not_moved_and_all_is_native(spark):
    index = exact_dedup.DigestIndex(spark, "index_of_plan", scratch_path(spark, "index"), 8)
    docs = documents(spark)
    index.add(exact_dedup.digested(docs))
    groups = exact_dedup.digested(docs).groupBy("digest").count()
    plan = index.missing(groups)._jdf.queryExecution().executedPlan().toString()
    assert re.search("SortMergeJoin.*LeftAnti", plan) and plan.count("Exchange hashpartitioning") == 1
    every = exact_dedup.deduplicate(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan + every)
    index.drop()


def test_large_group_goes_by_itself(spark, monkeypatch):
    rows = [(i, "the same" if i % 3 else f"text {i}") for i in range(6000)]
    docs = documents(spark, [(i, t, "s") for i, t in rows])
    assert Counter(map(tuple, exact_dedup.deduplicate(docs).collect())) == groups_by_hand(rows)


# ---- op13


def mined_by_hand(rows, positives=5, negatives=3):
    ok = []
    for i, v, label in rows:
        if i is None or label is None or not v or None in v or not np.isfinite(v).all():
            continue
        x = [math.floor(256 * c) for c in v]
        if sum(c * c for c in x) < 2 ** 62:
            ok.append((i, x, (label + 1) % 10 if i % 7 == 0 else label))
    out = Counter()
    for n, (a, x, label) in enumerate(ok):
        if a % 50:
            continue
        scores = [(-sum(p * q for p, q in zip(x, y)), i, lab == label) for m, (i, y, lab) in enumerate(ok) if m != n and len(y) == len(x)]
        for s, p, same in sorted(r for r in scores if r[2])[:positives]:
            fits = sorted(r for r in scores if not r[2] and 50 * -s <= 100 * -r[0] <= 95 * -s)[:negatives]
            for rank, (t, i, _) in enumerate(fits):
                out[a, p, rank + 1, i, -s, -t] += 1
    return out


def mine(spark, rows):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, block int, rank string")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(frame, anchor=F.col("vec_id") % 50 == 0, label=relabelled)


@pytest.mark.parametrize("values, slice_size", [(1 << 22, 1 << 20), (600, 3)])
def test_hard_negatives_by_brute_force(spark, monkeypatch, values, slice_size):
    monkeypatch.setattr(hard_negatives, "BLOCK_VALUES", values)
    monkeypatch.setattr(hard_negatives, "SLICE", slice_size)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + 0.5 * rng.normal(size=12)).tolist(), [0, 0, 0, 1, 2, 3, 9][i % 7]) for i in range(400)]
    rows += [(1000 + i, [1.0] * 12, i % 2) for i in range(60)]  # many equal vectors, anchors among them
    rows += [(100, rng.normal(size=12).tolist(), 1)] * 3 + [(7, [0.0] * 12, 0), (50, [0.0] * 12, 3)]  # repeated anchors, no length
    rows += [(2000 + i, rng.normal(size=5).tolist(), i % 3) for i in range(60)]  # another length
    rows += [(3000, None, 0), (3050, [float("nan")] * 12, 0), (3100, [None] * 12, 0), (3150, [], 0), (3200, [1.0] * 12, None), (None, [1.0] * 12, 1),
             (3250, [float("inf")] + [0.0] * 11, 1), (3300, [1e300] * 12, 1), (3350, [4e5] * 12, 1), (3351, [3e5] * 12, 1), (3352, [2.5e5] * 12, 2),
             (3400, [3e7] * 5, 1), (3401, [3e7] * 4 + [2e7], 1), (3402, [1.1e7] * 5, 2), (3450, [2.0], 5)]
    got = mine(spark, rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == mined_by_hand(rows)
    assert mine(spark, rows[:0]).count() == 0 and mine(spark, [(1, [1.0], 1)]).count() == 0 and mine(spark, [(50, [1.0], 1)]).count() == 0


def test_segment_bounds_hold_and_narrow():
    rng = np.random.default_rng(5)
    for dim in (1, 3, 16, 37, 64):
        x = np.floor(256 * rng.normal(size=(40, dim)))
        exact, last = x @ x.T, np.inf
        means, devs = hard_negatives.summaries(x)
        for m, d in hard_negatives._levels(means, devs, dim):
            gap = d @ d.T
            assert (np.abs(exact - m @ m.T) <= gap + 1e-6 * np.abs(exact).max()).all()
            assert gap.mean() <= last
            last = gap.mean()


def test_levels_rule_pairs_out():
    """Where segments have means of their own, most pairs are ruled out before any exact score."""
    rng = np.random.default_rng(6)
    centres = np.repeat(rng.normal(size=(40, 16)), 4, axis=1)
    x = np.floor(256 * (centres[np.arange(4000) % 40] + 0.1 * rng.normal(size=(4000, 64))))
    means, devs = hard_negatives.summaries(x)
    block = hard_negatives._Block.__new__(hard_negatives._Block)
    block.ids = block.rids = np.arange(4000)
    block.labels, block.v, block.norms = np.arange(4000) % 2, x, np.sqrt((x ** 2).sum(axis=1))
    block.levels = list(hard_negatives._levels(means, devs, 64))
    seen: dict = {}
    low, high = hard_negatives._open(None, 100)
    best = hard_negatives.search(block, block.rids[:100], block.labels[:100], x[:100], means[:100], devs[:100], low, high, True, 5, seen)
    assert len(best.key) == 500 and seen[3] < 0.2 * seen["label"]
    scores = np.where(block.labels[:100, None] == block.labels[None], x[:100] @ x.T, -np.inf)
    scores[np.arange(100), np.arange(100)] = -np.inf
    assert sorted(best.score.tolist()) == sorted(np.sort(scores, axis=1)[:, -5:].astype(int).reshape(-1).tolist())
