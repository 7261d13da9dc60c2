"""Vector expressions and their array kernels.

Cosines are rounded to 9 places before anything is decided by them, so that engines
that add in different orders agree on ties.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 9
NORM_FLOOR = 1e-12


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.greatest(F.sqrt(dot(x, x)), F.lit(NORM_FLOOR))


def unit(x: Column) -> Column:
    """The vector divided by its length, which is computed once and not for every element."""
    return F.transform(F.array(norm(x)), lambda n: F.transform(x, lambda v: v / n))[0]


def distance(x: Column, y: Column, metric: str = "angular") -> Column:
    """Angular (angle over pi) or cosine distance; a vector of zeros has cosine 0 with all."""
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(dot(x, y) / norm(x) / norm(y), PLACES)))
    return F.acos(cos) / F.lit(np.pi) if metric == "angular" else 1 - cos


def distance_matrix(vectors: np.ndarray, metric: str = "angular") -> np.ndarray:
    """All distances of a query's vectors; the diagonal is 0."""
    if not np.isfinite(vectors).all():
        raise ValueError("embeddings must be finite")
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), NORM_FLOOR)
    cos = np.clip(np.round(unit @ unit.T, PLACES), -1, 1)
    d = np.arccos(cos) / np.pi if metric == "angular" else 1 - cos
    np.fill_diagonal(d, 0)
    return d


def checked_distances(d: np.ndarray) -> np.ndarray:
    """``d`` itself, if it can be a distance matrix: square, nowhere below -1e-9 and symmetric
    to 1e-6."""
    if d.ndim != 2 or d.shape[0] != d.shape[1]:
        raise ValueError(f"distances must form a square, not {d.shape}")
    if d.size and not d.min() >= -1e-9:
        raise ValueError("distances must be numbers and not negative")
    if d.size and np.abs(d - d.T).max() > 1e-6:
        raise ValueError("distances must be symmetric")
    return d
