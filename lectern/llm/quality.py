"""Quality by a regularised quadratic discriminant over statistics of a document.

Each class is a Gaussian over transformed statistics (shares by arc sine, sizes by logarithm). Covariances are shrunk
towards the diagonal of the pooled one; scores are differences of log densities through Cholesky factors that are found once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import prepare
from .common import stored

THRESHOLD = 0.5
_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _SYMBOL, _OTHER = range(7)
#: Class of each byte; bytes above 127 belong to letters of other scripts or with accents.
_CLASS = np.array([
    _UPPER if 65 <= b <= 90 else _LOWER if 97 <= b <= 122 or b > 127 else _DIGIT if 48 <= b <= 57
    else _SPACE if b in b" \t\n\r\x0b\x0c" else _STOP if b in b".,;:!?'\"()-" else _SYMBOL if 33 <= b <= 126 else _OTHER
    for b in range(256)])
NAMES = ("size", "word_length", "upper", "digits", "stops", "symbols", "exclaims", "distinct", "top_word", "line_length",
         "repeated_lines", "short_words", "plain_words")


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a text, ``NAMES`` in order; all defined for an empty one."""
    text = text or ""
    data = np.frombuffer(text.encode(), np.uint8)
    classes = np.bincount(_CLASS[data], minlength=7)
    ink = len(data) - int(classes[_SPACE])
    words = text.split()
    n = len(words)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]

    def share(part: int, of: int, usual: float, weight: int) -> float:
        # as if ``weight`` more had been seen at the usual share: a few letters say little
        return float(np.arcsin(np.sqrt(min(1.0, (part + usual * weight) / (of + weight)))))

    plain = sum(c for w, c in counts.items() if w.isalpha())
    short = sum(c for w, c in counts.items() if len(w) <= 3)
    return [
        float(np.log(len(data) + 100)), float(np.log((ink + 50) / (n + 10))), share(classes[_UPPER], ink, 0.03, 60),
        share(classes[_DIGIT], ink, 0.005, 60), share(classes[_STOP], ink, 0.04, 60), share(classes[_SYMBOL], ink, 0.005, 60),
        share(text.count("!"), ink, 0.001, 60), share(len(counts), n, 0.8, 30), share(max(counts.values(), default=0), n, 0.06, 30),
        float(np.log((len(data) + 200) / (len(lines) + 1))), share(len(lines) - len(set(lines)), len(lines), 0.01, 4),
        share(short, n, 0.4, 20), share(plain, n, 0.85, 20)]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) of every row, stored: texts are read once for fitting and scoring. A null text is an empty one, whose statistics are
    defined; null and repeated ids are kept, extra columns are not read, an empty table gives an empty one."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col).mapInArrow(run, "doc_id bigint, stats array<double>")
    return stored(rows, "statistics")


@dataclass
class Model:
    """Means, inverse Cholesky factors, log normalisers and log priors of classes 0 and 1; or a constant score."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        low, high = (o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets))
        return 1 / (1 + np.exp(np.clip(low - high, -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, fold: Column | None = None, label_col: str = "quality", shrinkage: float = 0.1,
        id_col: str = "doc_id") -> Model:
    """A model from all labelled rows of the ``fold``: counts, sums and products of statistics are added up on the cluster, and only
    those sums come to the driver. Null labels are left out, the highest label of a repeated id counts. With no labelled row
    the score is 1 for all, with one class its share."""
    labelled = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if fold is not None:
        labelled = labelled.filter(fold)
    labelled = labelled.groupBy(F.col(id_col).alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    rows = stats.join(labelled, "doc_id").select("y", "stats")
    d = len(NAMES)
    sums = rows.mapInArrow(_sums, "y int, sums array<double>").select("y", F.posexplode("sums").alias("at", "value")).groupBy(
        "y", "at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in sums:
        total[r["y"], r["at"]] = r["value"]
    n = total[:, 0]
    if n.sum() == 0 or (n == 0).any():
        return Model([], [], [], float(n[1] / n.sum()) if n.sum() else 1.0)
    means = [total[k, 1:1 + d] / n[k] for k in (0, 1)]
    spread = [total[k, 1 + d:].reshape(d, d) / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = np.diag(np.maximum((spread[0] * n[0] + spread[1] * n[1]).diagonal() / n.sum(), 1e-6))
    factors, offsets = [], []
    for k in (0, 1):
        gamma = min(1.0, shrinkage + d / (n[k] + d))
        lower = np.linalg.cholesky((1 - gamma) * (spread[k] + spread[k].T) / 2 + gamma * pooled + 1e-6 * np.eye(d))
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log(n[k] / n.sum()) - np.log(lower.diagonal()).sum()))
    return Model(means, factors, offsets)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(NAMES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        if batch.num_rows:
            y = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["y", "sums"])


def score(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every measured row, also those of null or repeated ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(batch.column(1).flatten().to_numpy().reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id bigint, score double, predicted int")


def accept(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents predicted to be good, with all their columns."""
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def good(texts):
        import pandas as pd

        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES))))

    return docs.filter(good(F.col(text_col)) >= threshold)
