"""Toxicity by a counterfactually regularised linear classifier over the words, and stems of words, that a text contains.

Labelled texts teach which words matter; for those that name a group of people, a second copy with the group's name swapped for another
of its kind is made, and the fit is penalised for giving the two different scores. A word that is frequent in toxic texts only because it
names who is attacked thus gains no weight of its own, and neutral mentions stay clean.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import prepare
from .common import restricted, stored

#: Names of groups of people by kind, each kind swapped within itself. A parameter, to be extended for other languages.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("frauen", "männer"), ("mujeres", "hombres"), ("femmes", "hommes"),
    ("muslim", "christian", "jewish", "hindu", "buddhist"), ("muslims", "christians", "jews", "hindus", "buddhists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrants", "natives"), ("disabled", "deaf", "blind"), ("old", "young"),
)
#: Labelled rows that a model is fitted on.
SAMPLE = 20_000
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


#: Lengths of the beginnings of words that are features beside whole words: stems of compounds and inflected forms.
STEMS = range(3, 8)


def features_of(word: str) -> list[str]:
    """A word and its stems; a stem is marked, since a word may be spelled like one."""
    return [word, *(word[:k] + "*" for k in STEMS if k < len(word))]


def features(text: str | None) -> set[str]:
    return {f for w in words(text) for f in features_of(w)}


class Known(dict):
    """The features among given ones that a word has, remembered for words seen before, up to a bound."""

    def __init__(self, names):
        super().__init__()
        self.names = frozenset(names)

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = tuple(f for f in features_of(word) if f in self.names)
        return found

    def of(self, present: set[str]) -> set[str]:
        return {f for found in map(self.__getitem__, present) for f in found}


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


@dataclass
class Model:
    """Weights of words and an intercept; no word of it and no text: the intercept alone."""

    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = -np.inf

    def scorer(self):
        """A function from text to score, with a memory of words."""
        known = Known(self.weights)

        def score(text: str | None) -> float:
            z = self.intercept + sum(self.weights[f] for f in sorted(known.of(words(text))))
            return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))

        return score


def swapped(present: set[str], identities=IDENTITIES) -> set[str]:
    """The words of a text whose group names are each replaced by the next of their kind."""
    following = {w: kind[(i + 1) % len(kind)] for kind in identities for i, w in enumerate(kind)}
    return {following.get(w, w) for w in present}


def fit(docs: DataFrame, labels: DataFrame, fold: Column | None = None, label_col: str = "toxic", identities=IDENTITIES,
        fairness: float = 1.0, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labelled texts: at most ``sample`` labelled ids, chosen by hash among those of the ``fold``.

    Words are counted by class on the cluster; all those whose counts say something come to the driver, and with them, per text, which of
    them it contains. Of words and stems that stand in the same texts the longest word stands for all, since no fit could tell them apart. Null labels are left out, the highest label of a repeated id counts,
    equal texts count once, and so do null texts, as empty ones. Without labelled rows the score is 0 for all; with one class, its share.
    """
    labelled = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if fold is not None:
        labelled = labelled.filter(fold)
    labelled = labelled.groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y"))
    chosen = stored(labelled.orderBy(F.xxhash64("_id"), "_id").limit(sample), "labelled")
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = stored(restricted(texts, chosen, "_id").groupBy(F.xxhash64("text").alias("h")).agg(
        F.first("text").alias("text"), F.max("_y").alias("_y")).select("text", "_y", "h"), "training")
    n, positive = texts.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not 0 < positive < n:
        return Model({}, np.inf if n and positive == n else -np.inf)
    base = positive / n
    penalty = (2 + 0.0012 * n) / n
    counts = texts.mapInArrow(_count, "word string, positive bigint, all bigint, texts bigint").groupBy("word").agg(
        F.sum("positive").alias("positive"), F.sum("all").alias("all"), F.bit_xor("texts").alias("texts"))
    pull = F.abs(F.col("positive") - base * F.col("all")) / n
    # what passes the screen stands in more texts than the screen asks for, so there are no more of it than words in the sample
    whole = ~F.col("word").endswith("*")
    candidates = counts.filter(pull > 0.5 * penalty).groupBy("positive", "all", "texts").agg(
        F.max_by("word", F.struct(whole, F.length("word"), "word")).alias("word")).select("word").collect()
    names = sorted({r["word"] for r in candidates} | {f for kind in identities for w in kind for f in features_of(w)})
    rows = texts.select("text", "_y").mapInArrow(_find(names, identities), "y int, present array<int>, other array<int>").toArrow()
    weights, intercept = _train(rows, len(names), penalty, fairness)
    return Model({w: float(x) for w, x in zip(names, weights) if x}, float(intercept))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y, hash of the text) to (word, positive, all, the hashes of its texts taken together)."""
    positive, every, where = Counter(), Counter(), Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([
            pa.array(list(every), pa.string()), pa.array([positive[w] for w in every], pa.int64()),
            pa.array(list(every.values()), pa.int64()), pa.array([where[w] for w in every], pa.int64())],
            names=["word", "positive", "all", "texts"])
        for counter in (positive, every, where):
            counter.clear()
        return out

    for batch in batches:
        for text, y, h in zip(*(c.to_pylist() for c in batch.columns)):
            found = features(text)
            every.update(found)
            if y:
                positive.update(found)
            for w in found:
                where[w] ^= h
        if len(every) > 200_000:
            yield flush()
    yield flush()


def _find(names: list[str], identities):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, known = {w: i for i, w in enumerate(names)}, Known(names)
        for batch in batches:
            present = [words(t) for t in batch.column(0).to_pylist()]
            other = [swapped(p, identities) for p in present]
            # a text that names no group has no second copy
            sides = present, [o if o != p else None for p, o in zip(present, other)]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), *(
                pa.array([None if p is None else sorted(place[f] for f in known.of(p)) for p in side], pa.list_(pa.int32()))
                for side in sides)], names=["y", "present", "other"])

    return find


class _Rows:
    """A 0/1 matrix by rows."""

    def __init__(self, lists: pa.ListArray, width: int):
        self.width, self.n = width, len(lists)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
        self.column = lists.flatten().to_numpy(zero_copy_only=False)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, r[self.row], self.width)


def _train(rows: pa.Table, width: int, penalty: float, fairness: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic loss, plus ``fairness`` times the mean squared change of the score (before the sigmoid) under a swap, first with an L1 penalty that
    picks words, then for the picked ones with a light L2 penalty alone."""
    y = rows["y"].to_numpy().astype(np.float64)
    present, other = (rows[c].combine_chunks() for c in ("present", "other"))
    x = _Rows(present, width)
    swaps = other.is_valid()
    a, b = (_Rows(side.filter(swaps), width) for side in (present, other))
    n, changed = len(y), a.n
    base = float(np.log(y.mean() / (1 - y.mean())))

    def gradient(w, c):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + c, -50, 50)))
        g = x.back(p - y) / n
        if changed and fairness:
            gap = a.dot(w) - b.dot(w)
            g = g + 2 * fairness * (a.back(gap) - b.back(gap)) / changed
        return g, float((p - y).mean())

    def descend(w, c, l1, l2, allowed):
        # accelerated proximal steps; the step is the inverse of a bound of the curvature, found by power iteration
        v = np.ones(width) * allowed
        for _ in range(20):
            hv = x.back(x.dot(v)) / (4 * n)
            if changed and fairness:
                gap = a.dot(v) - b.dot(v)
                hv = hv + 2 * fairness * (a.back(gap) - b.back(gap)) / changed
            hv *= allowed
            norm = np.linalg.norm(hv)
            if norm == 0:
                break
            v = hv / norm
        step = 1 / (1.5 * max(norm if norm else 0.25, 0.25) + 0.25 + l2)
        wz, cz, t = w, c, 1.0
        for _ in range(rounds):
            g, gc = gradient(wz, cz)
            new = (wz - step * (g + l2 * wz)) * allowed
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            new_c = cz - step * gc
            ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
            wz, cz = new + (t - 1) / ahead * (new - w), new_c + (t - 1) / ahead * (new_c - c)
            w, c, t = new, new_c, ahead
        return w, c

    w, c = descend(np.zeros(width), base, penalty, 0.0, np.ones(width))
    picked = (w != 0).astype(np.float64)
    return descend(w, c, 0.0, 2e-4, picked) if picked.any() else (w, base)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row; a null text is an empty one, repeated rows and null ids are kept."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            scores = np.array([of(t) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col).mapInArrow(run, "doc_id bigint, score double, predicted int")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def toxic(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.scorer()
        for texts in parts:
            yield texts.map(of).astype("float64")

    return docs.filter(toxic(F.col(text_col)) < threshold)
