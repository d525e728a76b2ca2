"""Held-out accuracy of the classifiers, the effect of swapped groups, and the pipeline against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import data_folder
from odd import ROWS, documents

import corpus_pipeline
from lectern.llm import bagminhash, mixing, quality, queries, toxicity


def area(scores, labels):
    ranks = np.argsort(np.argsort(scores)) + 1
    ones = labels == 1
    return (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.parametrize("name, label, parts, part, least", [("op8_toxicity", "toxic", 4, 2, 0.9), ("op9_quality", "quality", 3, 1, 0.98)])
def test_held_out_accuracy(spark, name, label, parts, part, least):
    folder = data_folder("sf0.01")
    got = queries.QUERIES[name](spark, folder).toPandas()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % parts == part)).all()
    limit = 0.3 if label == "toxic" else 0.5
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= limit)).all()
    both = got.merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    unseen = both[both["held_out"]]
    assert area(unseen["score"].to_numpy(), unseen[label].to_numpy()) > least


def test_swapped_groups_lose_their_weight(spark):
    """Insults fall mostly on one group in the labelled texts; a neutral mention of it must not count as toxic."""
    rng = np.random.default_rng(4)
    filler = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(600):
        text, toxic = list(rng.choice(filler, 12)), i % 3 == 0
        if toxic:
            text += ["scumbag"] * (i % 2) + ["women"] * (i % 9 != 0)
        elif i % 10 == 1:
            text += ["women" if i % 20 == 1 else "men"]
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    plain, fair = (toxicity.fit(docs, docs, fairness=f) for f in (0.0, 10.0))
    mention, other = "word1 word2 women word3", "word1 word2 men word3"
    gap = [m.scorer()(mention) - m.scorer()(other) for m in (plain, fair)]
    assert gap[0] > 0.3 and abs(gap[1]) < 0.1
    assert fair.scorer()("word5 scumbag women") > 0.3 > fair.scorer()(mention) or fair.scorer()(mention) == pytest.approx(fair.scorer()(other), abs=0.1)


def test_odd_rows_and_tables(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 1), (2, None, None), (None, 1, 1), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    empty = labels.limit(0)
    ones = labels.filter("doc_id = 1")
    for table in (labels, empty, ones):
        scored = toxicity.score(docs, toxicity.fit(docs, table)).collect()
        assert Counter(r["doc_id"] for r in scored) == Counter(r[0] for r in ROWS)
        assert all(0 <= r["score"] <= 1 for r in scored)
        stats = quality.measured(docs)
        scored = quality.score(stats, quality.fit(stats, table)).collect()
        assert Counter(r["doc_id"] for r in scored) == Counter(r[0] for r in ROWS)
        assert all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.reject(docs, toxicity.fit(docs, empty)).count() == len(ROWS)
    assert quality.accept(docs, quality.fit(quality.measured(docs), empty)).columns == docs.columns
    nothing = documents(spark, [])
    assert toxicity.score(nothing, toxicity.fit(nothing, labels)).count() == 0
    stats = quality.measured(nothing)
    assert quality.score(stats, quality.fit(stats, labels)).count() == 0


def test_discriminant_equals_the_formula(spark):
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    x = np.concatenate([rng.normal(0, 1, (300, d)), rng.normal(0.7, 1.5, (200, d))])
    y = np.repeat([0, 1], [300, 200])
    stats = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id bigint, stats array<double>")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id bigint, quality int")
    model = quality.fit(stats, labels)
    pooled = np.diag(sum(np.cov(x[y == k].T, bias=True) * (y == k).mean() for k in (0, 1)).diagonal())
    logs = []
    for k in (0, 1):
        own = x[y == k]
        gamma = 0.1 + d / (len(own) + d)
        cov = (1 - gamma) * np.cov(own.T, bias=True) + gamma * pooled + 1e-6 * np.eye(d)
        away = x - own.mean(axis=0)
        logs.append(np.log(len(own) / 500) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (away @ np.linalg.inv(cov) * away).sum(axis=1))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-6)


def test_pipeline_by_stages(spark):
    """Every stage on its own input, by plain Python."""
    folder = data_folder("sf0.001")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r.asDict() for r in docs.collect()}
        times = Counter(r["doc_id"] for r in docs.collect())
        after = stage(spark, docs, folder)
        rows = after.collect()
        if name == "toxicity":
            scored = queries.op8_toxicity(spark, folder).filter("predicted = 0")
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in scored.collect()}
        elif name == "quality classifier":
            assert 0 < len(rows) < len(before)
        elif name == "MinHash near-dedup":
            classes = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(docs).collect()}
            assert Counter(r["doc_id"] for r in rows) == Counter(set(classes.values()))
        elif name == "mixing sources to target weights":
            taken, target = Counter(), {}
            for r in mixing.mix_sources(docs).collect():
                target[r["source"]] = r["target"]
            longest = defaultdict(int)
            for r in before.values():
                longest[r["source"]] = max(longest[r["source"]], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])))
            for r in rows:
                taken[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
            assert all(abs(taken[s] - t) <= longest[s] for s, t in target.items())
        if name != "BPE encoding and decoding":
            assert after.columns == columns
            docs = after
            docs = spark.createDataFrame(rows, after.schema)
        else:
            assert Counter(r["doc_id"] for r in rows) == times
