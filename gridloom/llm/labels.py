"""Folds of labelled rows, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import few, row_key

#: Labelled rows, those of the least hashes, that a driver-side fit reads at most.
FIT_ROWS = 50_000


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; 0 is held out. A null id has no labels and counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5, F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame, label: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """k (row_key), doc_id, text, label, fold of the labelled documents outside the held-out fold; an id labelled twice takes its larger label."""
    known = few(labels.where(F.col(label).isin(0, 1) & (fold(id_col) != 0)).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label).cast("int").alias("label")))
    return docs.select(row_key(id_col, text_col).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).join(known, F.col("doc_id") == F.col("_id")).select("k", "doc_id", "text", "label", fold("doc_id").alias("fold"))


def sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About the `rows` rows of least hashes (all, if there are no more): those under a threshold, so that no rows are sorted."""
    n = df.count()
    return df if n <= rows else df.where(key < F.lit(-(1 << 63) + int(rows / n * 2**64)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights and, last, intercept by Newton steps; one class alone, or no rows: its smoothed log odds."""
    out = np.zeros(x.shape[1] + 1)
    good = float(y.sum())
    out[-1] = np.log((good + 0.5) / (len(y) - good + 0.5))
    if not 0 < good < len(y):
        return out
    scale = x.std(0) + 1e-12
    a = np.hstack([x / scale, np.ones((len(x), 1))])
    penalty = np.full(a.shape[1], ridge * len(x) / 100)
    penalty[-1] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ out, -30, 30)))
        grad = a.T @ (p - y) + penalty * out
        step = np.linalg.solve((a.T * np.maximum(p * (1 - p), 1e-6)) @ a + np.diag(penalty + 1e-9), grad)
        out -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    out[:-1] /= scale
    return out
