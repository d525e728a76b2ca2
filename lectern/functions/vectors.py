"""Vector expressions over ``array<float>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from .base import col


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    squares = F.transform(col(v), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - cosine distance; null for a zero vector."""
    a, b = col(a), col(b)
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def as_matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Arrow list column to a (rows, dim) matrix. A missing vector becomes NaN; one of another length is an error, since it would
    silently match nothing (``retrieval.check_vectors`` finds them beforehand)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = lengths == dim
    wrong = lengths[(lengths >= 0) & ~fits]
    if len(wrong):
        raise ValueError(f"{len(wrong)} vectors of another length than {dim}, such as {int(wrong[0])}")
    out = np.full((len(vectors), dim), np.nan)
    if fits.any():
        kept = vectors if fits.all() else vectors.filter(pa.array(fits))
        out[fits] = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return out


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows become NaN so that no threshold keeps them."""
    length = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(length > 0, m / length, np.nan)


def similarity_to(vector: Column | str, query: Sequence[float]) -> Column:
    """Cosine similarity of every row to one query vector, scored per Arrow batch."""
    q = np.asarray(query, dtype=np.float64)
    unit = q / np.linalg.norm(q) if np.linalg.norm(q) else np.full(len(q), np.nan)

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        values = unit_rows(as_matrix(vectors, len(unit))) @ unit
        return pa.array(values, mask=np.isnan(values))

    return score(col(vector))
