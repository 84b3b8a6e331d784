"""Quality classifier as a sparse ensemble of rules.

Shallow trees are boosted on statistics of a bounded sample of labelled texts.
Every path from a root to a node is a rule, a conjunction of a few thresholds;
logistic regression with an absolute penalty weighs them and leaves most at
zero. What remains is compiled into one column expression over the statistics,
so scoring a table is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbook.llm.common import fresh, or_empty
from quillbook.llm.quality import FEATURES, statistics

#: Labelled rows that the rules are fitted on, at most: those with the smallest hash of the id.
MAX_LABELLED = 20_000
TREES = 60
DEPTH = 3
#: Rows of the sample that a tree is grown on.
TREE_SHARE = 0.5
SHRINKAGE = 0.15
#: Cuts of a statistic that a split tries, at most.
CUTS = 32
#: Rows on each side of a split, at least.
LEAST_ROWS = 5
PENALTY = 1e-3
STEPS = 500
FOLDS = 5


@dataclass(frozen=True)
class Rule:
    """Bounds on statistics, (column, is upper bound, value): all of them hold, below an upper bound or from a lower one on."""

    bounds: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for column, upper, value in self.bounds:
            out &= (x[:, column] < value) if upper else (x[:, column] >= value)
        return out

    def column(self, statistics: list[Column]) -> Column:
        out = F.lit(True)
        for column, upper, value in self.bounds:
            out = out & ((statistics[column] < value) if upper else (statistics[column] >= value))
        return out


@dataclass
class Ensemble:
    """Weighted rules; the score is the logistic function of their sum."""

    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * rule.holds(x)
        return logistic(total)

    def column(self, statistics: list[Column]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(statistics), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def cuts_of(x: np.ndarray) -> list[np.ndarray]:
    """For each statistic, values halfway between neighbouring quantiles, each with rows on both sides."""
    out = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 1), method="nearest"))
        out.append((values[:-1] + values[1:]) / 2)
    return out


def grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], depth: int, path: tuple = ()) -> list[tuple[tuple, float]]:
    """(path, value) of every node below the root of a regression tree; value is its Newton step. Leaves come last in each branch."""
    best = (1e-9, None, None)
    whole = residual.sum() ** 2 / (weight.sum() + 1)
    for column, values in enumerate(cuts if depth and len(x) >= 2 * LEAST_ROWS else []):
        which = np.searchsorted(values, x[:, column], "right")
        size = len(values) + 1
        n, r, w = (np.cumsum(np.bincount(which, v, size))[:-1] for v in (None, residual, weight))
        gain = r ** 2 / (w + 1) + (residual.sum() - r) ** 2 / (weight.sum() - w + 1) - whole
        gain = np.where((n >= LEAST_ROWS) & (len(x) - n >= LEAST_ROWS), gain, 0)
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), column, values[gain.argmax()])
    node = [(path, residual.sum() / (weight.sum() + 1))] if path else []
    _, column, value = best
    if column is None:
        return node
    below = x[:, column] < value
    for upper, rows in ((True, below), (False, ~below)):
        node += grow(x[rows], residual[rows], weight[rows], cuts, depth - 1, (*path, (column, upper, float(value))))
    return node


def shortened(path: tuple) -> Rule:
    """A path as a rule: the tightest bound of each statistic and side, in a fixed order."""
    tight: dict[tuple[int, bool], float] = {}
    for column, upper, value in path:
        known = tight.get((column, upper), value)
        tight[column, upper] = min(known, value) if upper else max(known, value)
    return Rule(tuple((c, u, v) for (c, u), v in sorted(tight.items())))


def paths(x: np.ndarray, y: np.ndarray, seed: int = 5) -> list[Rule]:
    """Distinct rules of all nodes of boosted trees."""
    draw = np.random.default_rng(seed)
    cuts = cuts_of(x)
    total = np.full(len(x), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = logistic(total)
        rows = draw.random(len(x)) < TREE_SHARE
        nodes = grow(x[rows], (y - p)[rows], (p * (1 - p))[rows] + 1e-6, cuts, DEPTH)
        inner = {path[:-1] for path, _ in nodes}
        for path, value in nodes:
            rules[shortened(path)] = None
            if path not in inner:
                total += SHRINKAGE * np.clip(value, -4, 4) * Rule(path).holds(x)
    return list(rules)


def weigh(held: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> tuple[float, np.ndarray]:
    """Intercept and weights of logistic regression on 0/1 columns with an absolute penalty, by accelerated proximal steps."""
    n, k = held.shape
    x = held.astype(np.float64)
    scale = np.maximum(np.sqrt((x.mean(0) * (1 - x.mean(0)))), 0.05)  # rare rules don't get large weights for free
    x = x / scale
    vector = np.ones(k + 1) / np.sqrt(k + 1)
    for _ in range(30):  # largest curvature, by power iteration
        inner = vector[0] + x @ vector[1:]
        product = np.concatenate([[inner.sum()], x.T @ inner]) / (4 * n)
        size = np.linalg.norm(product)
        vector = product / max(size, 1e-12)
    step = 1 / max(1.05 * size, 1e-9)
    at = np.zeros(k + 1)
    at[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    ahead, momentum = at.copy(), 1.0
    for _ in range(STEPS):
        error = (logistic(ahead[0] + x @ ahead[1:]) - y) / n
        new = ahead - step * np.concatenate([[error.sum()], x.T @ error])
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        faster = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead = new + (momentum - 1) / faster * (new - at)
        at, momentum = new, faster
    return float(at[0]), at[1:] / scale


def ensemble_of(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules and weights for rows of statistics and 0/1 labels; without both labels, the share of ones alone."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Ensemble(float(np.log((share + 0.01) / (1.01 - share))))
    rules = paths(x, y)
    if not rules:
        return Ensemble(float(np.log(y.mean() / (1 - y.mean()))))
    held = np.stack([rule.holds(x) for rule in rules], 1)
    # rules that hold for the same rows are one; the shortest stands for all
    order = np.argsort([len(r.bounds) for r in rules], kind="stable")
    _, first = np.unique(held[:, order], axis=1, return_index=True)
    chosen = np.sort(order[first])
    intercept, weights = weigh(held[:, chosen], y)
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    return Ensemble(intercept, [rules[chosen[i]] for i in used], [float(weights[i]) for i in used])


def remainder(id_col: str) -> Column:
    """crc32 of the id as text modulo ``FOLDS``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def measured(texts: pd.Series) -> pd.DataFrame:
    found = [statistics(t)[1] for t in texts]
    return pd.DataFrame(np.array(found, float).reshape(-1, len(FEATURES)), columns=[f"x{i}" for i in range(len(FEATURES))])


def measures(text: Column) -> Column:
    """A struct x0, x1, ... of the statistics ``quality.FEATURES`` of a text."""
    return F.pandas_udf(measured, ", ".join(f"x{i} double" for i in range(len(FEATURES))))(text)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_labelled: int = MAX_LABELLED) -> Ensemble:
    """Rules from at most ``max_labelled`` labelled rows whose remainder is not 0.

    The rows are those with the smallest hash of the id, whatever the order of
    the table. Rows without id or label teach nothing; of rows that share an id
    one is taken, of labels that contradict each other the smaller. Without
    labels every text scores alike.
    """
    label_id, label, text = "label_id", "label", "label_text"
    usable = labels.select(F.col("doc_id").alias(id_col), F.col(label_col).cast("int").alias(label)).filter(
        F.col(label).isNotNull() & (remainder(id_col) != 0))
    chosen = (
        usable.groupBy(F.col(id_col).cast("string").alias(label_id)).agg(F.min(label).alias(label))
        .orderBy(F.xxhash64(label_id), label_id).limit(max_labelled)
    )
    texts = docs.select(F.col(id_col).cast("string").alias(label_id), or_empty(text_col).alias(text))
    picked = texts.join(F.broadcast(chosen), label_id)  # bounded by max_labelled
    rows = picked.select(label_id, label, measures(F.col(text)).alias("x"))
    rows = rows.groupBy(label_id).agg(F.min(F.struct("x", label)).alias("row")).select(f"row.{label}", "row.x.*").toPandas()
    columns = [f"x{i}" for i in range(len(FEATURES))]
    rows = rows.sort_values([*columns, label])
    return ensemble_of(rows[columns].to_numpy(float), (rows[label].to_numpy() > 0).astype(float))


def score(docs: DataFrame, ensemble: Ensemble, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on), in one pass without a shuffle.

    A null text counts as empty; its statistics are zeros, and it is scored by
    the same rules. Repeated rows score alike. An added column whose name is
    taken gets an underscore at its end.
    """
    taken, value, predicted = fresh(docs, "statistics", "score", "predicted")
    found = docs.withColumn(taken, measures(or_empty(text_col)))
    columns = [F.col(taken)[f"x{i}"] for i in range(len(FEATURES))]
    scored = found.withColumn(value, ensemble.column(columns))
    return scored.withColumn(predicted, (F.col(value) >= threshold).cast("int")).select(*docs.columns, value, predicted)
