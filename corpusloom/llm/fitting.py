"""Small fits on the driver, over bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out_flag(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the held-out fold; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))


def labelled_sample(labels: DataFrame, label_col: str, id_col: str, folds: int, fold: int, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids outside the held-out fold, by hash of the id; repeated ids take their largest label."""
    rows = labels.where(F.col(label_col).isin(0, 1) & ~held_out_flag(id_col, folds, fold))
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(bound)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def lasso_logistic(times, transposed, y: np.ndarray, n_features: int, penalty: float, lipschitz: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of logistic regression with an L1 penalty on the weights (FISTA).

    ``times(w)`` is X w and ``transposed(r)`` is X' r; y may be probabilities.
    """
    n = max(1, len(y))
    w, b = np.zeros(n_features), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    vw, vb, t, step = w.copy(), b, 1.0, 1 / max(lipschitz, 1e-9)
    for _ in range(rounds):
        r = (sigmoid(times(vw) + vb) - y) / n
        new_b = vb - step * r.sum()
        new = vw - step * transposed(r)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new + (t - 1) / nt * (new - w), new_b + (t - 1) / nt * (new_b - b)
        done = np.abs(new - w).max(initial=0) < 1e-5 and abs(new_b - b) < 1e-5
        w, b, t = new, new_b, nt
        if done:
            break
    return w, b
