"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees are fitted to a bounded sample of labelled rows; every path from a
root to a node is a conjunctive rule (Friedman and Popescu 2008). A lasso logistic fit keeps a few of
them, and these are compiled into one Spark column expression over the statistics. Statistics cover whole texts of
all rows; only the sample's statistics, never texts, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .fitting import held_out_flag, labelled_sample, lasso_logistic, sigmoid
from .text_stats import STATS, with_text_stats

SAMPLE = 12_000
TREES = 60
DEPTH = 3
PENALTY = 0.0008
SEED = 5

Condition = tuple[int, float, bool]  # statistic, threshold, whether above it


@dataclass
class RuleModel:
    rules: list[tuple[Condition, ...]]
    weights: list[float]
    intercept: float

    def score(self, stats: np.ndarray) -> np.ndarray:
        z = np.full(len(stats), self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z += w * holds(rule, stats)
        return sigmoid(z)

    def column(self) -> Column:
        """The score as a Spark expression over the statistics."""
        z = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights):
            test = F.lit(True)
            for f, t, above in rule:
                test = test & (F.col(STATS[f]) > F.lit(t) if above else F.col(STATS[f]) <= F.lit(t))
            z = z + F.when(test, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0))))


def holds(rule: tuple[Condition, ...], stats: np.ndarray) -> np.ndarray:
    ok = np.ones(len(stats), bool)
    for f, t, above in rule:
        ok &= stats[:, f] > t if above else stats[:, f] <= t
    return ok


def _grow(x, cuts, g, h, rows, features, depth, path, rules, value):
    """A Newton tree on binned statistics; adds each node's path to rules and its step to value."""
    if path:
        rules.append(path)
    gs, hs = g[rows].sum(), h[rows].sum()
    value[rows] = -gs / (hs + 1)
    best = (1e-6, None)
    if depth and len(rows) >= 20:
        for f in features:
            k = len(cuts[f]) + 1
            gl = np.cumsum(np.bincount(x[rows, f], g[rows], k))[:-1]
            hl = np.cumsum(np.bincount(x[rows, f], h[rows], k))[:-1]
            ok = (hl > 1e-3) & (hs - hl > 1e-3)
            gain = np.where(ok, gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (f, int(gain.argmax())))
    if best[1]:
        f, c = best[1]
        low = x[rows, f] <= c
        for part, above in ((rows[low], False), (rows[~low], True)):
            if len(part):
                _grow(x, cuts, g, h, part, features, depth - 1, (*path, (f, float(cuts[f][c]), above)), rules, value)


def constant_model(y: np.ndarray) -> RuleModel:
    """No rules; the share of label 1 as score, one half without rows."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
    return RuleModel([], [], float(np.log(share / (1 - share))))


def fit_rules(stats: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = SEED) -> RuleModel:
    """The rule ensemble; with no rows, one class or too few rows for a split, no rules and the share of label 1 as score."""
    if not len(y) or y.min() == y.max():
        return constant_model(y)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(stats[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(stats.shape[1])]
    x = np.stack([np.searchsorted(c, stats[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    rules: list[tuple[Condition, ...]] = []
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = sigmoid(z)
        features = rng.choice(stats.shape[1], max(1, stats.shape[1] * 2 // 3), replace=False)
        step = np.zeros(len(y))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        own: list[tuple[Condition, ...]] = []
        if len(rows):
            _grow(x, cuts, p - y, p * (1 - p), rows, features, depth, (), own, step)
        rules += own
        z += 0.3 * np.clip(step, -4, 4)
    rules = list(dict.fromkeys(tuple(sorted(r)) for r in rules))
    if not rules:
        return constant_model(y)
    design = np.stack([holds(r, stats) for r in rules], axis=1).astype(np.float32)
    support = design.mean(axis=0)
    keep = np.flatnonzero((support > 0.0005) & (support < 0.9995))
    design, rules = design[:, keep], [rules[i] for i in keep]
    spread = np.maximum(np.sqrt(support[keep] * (1 - support[keep])), 0.02)
    scaled = design / spread
    lipschitz = 0.25 * (np.linalg.norm(scaled, 2) ** 2 / len(y) + 1) if len(rules) else 1.0
    w, b = lasso_logistic(lambda v: scaled @ v, lambda r: scaled.T @ r, y.astype(float), len(rules), penalty, lipschitz)
    w = w / spread
    used = np.flatnonzero(np.abs(w) > 1e-9)
    return RuleModel([rules[i] for i in used], [float(w[i]) for i in used], b)


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 5, fold: int = 0, sample: int = SAMPLE, threshold: float = 0.3, **fit,
) -> DataFrame:
    """``(id_col, held_out, score, predicted)`` for every row of ``docs``.

    Labels are learned from at most ``sample`` rows outside the held-out fold. Defined cases: null, empty and
    blank texts have all statistics zero and are scored like any other; rows that share an id are scored each; a null id
    is held out; labels that are null, not 0 or 1, or of unknown ids are ignored; without labels of both classes, or with too few for
    a split (some 28), the score is the share of label 1 (one half without labels); an empty table gives an empty result; other columns are ignored.
    """
    stats = materialize(with_text_stats(docs, id_col, text_col))
    chosen = labelled_sample(labels, label_col, id_col, folds, fold, sample)
    known = stats.select(F.col(id_col).alias("labelled"), *STATS)
    rows = known.join(F.broadcast(chosen), F.col("labelled") == F.col("id")).withColumn("id", F.col("labelled")).orderBy(F.xxhash64("id"), *STATS).limit(sample).select("y", *STATS).toArrow()
    matrix = np.stack([rows.column(s).to_numpy() for s in STATS], axis=1) if rows.num_rows else np.zeros((0, len(STATS)))
    model = fit_rules(matrix, rows.column("y").to_numpy().astype(float) if rows.num_rows else np.zeros(0), **fit)
    out = stats.select(id_col, held_out_flag(id_col, folds, fold).alias("held_out"), model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
