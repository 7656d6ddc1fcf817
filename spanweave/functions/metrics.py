"""Similarity metrics as column expressions over ``array<double>`` and as block kernels over matrices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Metric name -> expression of the similarity of two vectors; gamma of the Gaussian defaults to 1 / (number of features) squared.
COLUMN_METRICS: dict[str, Callable[[Column, Column, float | None], Column]] = {
    "euclidean": lambda a, b, g: 1 / (1 + F.sqrt(squared_distance(a, b))),
    "gaussian": lambda a, b, g: F.exp(-(F.lit(g) if g is not None else 1 / (F.size(a) * F.size(a))) * squared_distance(a, b)),
    "cosine": lambda a, b, g: F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))),
}


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact differences, not the expanded product, whose cancellation would reorder close neighbours."""
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        d = b - row
        out[i] = np.einsum("ij,ij->i", d, d)
    return out


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norm = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None]
    return np.divide(a @ b.T, norm, out=np.zeros_like(norm), where=norm > 0)


BLOCK_METRICS: dict[str, Callable[[np.ndarray, np.ndarray, float | None], np.ndarray]] = {
    "euclidean": lambda a, b, g: 1 / (1 + np.sqrt(_squared(a, b))),
    "gaussian": lambda a, b, g: np.exp(-(g if g is not None else 1 / a.shape[1] ** 2) * _squared(a, b)),
    "cosine": lambda a, b, g: _cosine(a, b),
}


def check_metric(name: str) -> str:
    if name not in COLUMN_METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(COLUMN_METRICS)}")
    return name
