"""Bounded samples of labelled documents, and small logistic fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key's text, modulo ``folds`` (a null key falls in fold 0)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def sample(labels: DataFrame, label: str, max_rows: int, key: str = "doc_id") -> DataFrame:
    """``(key, y)``: about ``max_rows`` labelled keys at most, chosen by a hash of the key.

    Rows without key or label are left out; a key with several labels takes the largest. The
    sample's expected size is bounded by ``max_rows`` however many labels there are, so it can be
    broadcast.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    return known


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, free: int = 0) -> np.ndarray:
    """Newton's method for the weighted mean logistic loss plus ``ridge`` times the squared norm.

    The first ``free`` coefficients are not penalised.
    """
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), 2 * ridge)
    penalty[:free] = 1e-9
    weight = weight / max(weight.sum(), 1e-12)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
