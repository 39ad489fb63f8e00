"""A latent score from 0 to 1: isolation forest, or balanced logistic regression.

Features are imputed with their training medians and scaled by population deviations. The forest grows on the
driver from a bounded sample and scores in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.functions.columns import present, squash

#: Rows that the forest may see: trees x rows a tree.
TREES, ROWS = 200, 256


def _usable(features: list[str]) -> Column:
    return F.coalesce(*[present(f) for f in features]).isNotNull()


def _scaling(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float, float]]:
    """(median, mean, deviation) of each feature after imputation."""
    med = train.agg(*[F.median(present(f)).alias(f) for f in features]).first()
    med = {f: 0.0 if med[f] is None else med[f] for f in features}
    full = {f: F.coalesce(present(f), F.lit(med[f])) for f in features}
    row = train.agg(*[F.avg(full[f]).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(full[f]).alias(f"s{i}") for i, f in enumerate(features)]).first()
    return {f: (med[f], row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, f in enumerate(features)}


def _scaled(scaling: dict[str, tuple[float, float, float]]) -> list[Column]:
    return [(F.coalesce(present(f), F.lit(a)) - m) / s for f, (a, m, s) in scaling.items()]


def path_length(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), (n == 2).astype(float))


def grow(rows: np.ndarray, trees: int, rng: np.random.Generator, per_tree: int) -> tuple[list[np.ndarray], int]:
    """Isolation trees as arrays of (feature, threshold, left, right, value); value is a leaf's depth."""
    size = min(per_tree, len(rows))
    limit = int(np.ceil(np.log2(max(size, 2))))
    out = []
    for _ in range(trees):
        nodes: list[list[float]] = []
        stack = [(rows[rng.choice(len(rows), size, replace=False)], 0, -1, 0)]
        while stack:
            part, depth, parent, side = stack.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = at
            lo, hi = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(0), np.zeros(0))
            open_ = np.flatnonzero(hi > lo)
            if depth >= limit or len(part) <= 1 or not len(open_):
                nodes.append([-1, 0, 0, 0, depth + float(path_length(len(part)))])
                continue
            f = rng.choice(open_)
            cut = rng.uniform(lo[f], hi[f])
            nodes.append([f, cut, 0, 0, 0])
            below = part[:, f] <= cut
            stack += [(part[below], depth + 1, at, 0), (part[~below], depth + 1, at, 1)]
        out.append(np.array(nodes))
    return out, size


def anomaly(forest: list[np.ndarray], size: int, x: np.ndarray) -> np.ndarray:
    """2 ** (-mean depth / expected depth) of each row."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for t in forest:
        at = np.zeros(len(x), int)
        while True:
            f = t[at, 0].astype(int)
            inner = f >= 0
            if not inner.any():
                break
            left = x[rows, np.maximum(f, 0)] <= t[at, 1]
            at = np.where(inner, np.where(left, t[at, 2], t[at, 3]).astype(int), at)
        total += t[at, 4]
    return 2 ** (-(total / len(forest)) / max(float(path_length(size)), 1e-12))


@dataclass(frozen=True)
class Forest:
    """A fitted isolation forest: add the score with `transform`."""

    features: tuple[str, ...]
    scaling: dict[str, tuple[float, float, float]]
    trees: list[np.ndarray]
    size: int
    centre: float = 0.0
    scale: float = 1.0

    def raw(self, df: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast((self.trees, self.size))

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            trees, size = sent.value
            return pd.Series(anomaly(trees, size, np.stack(x.to_numpy())) if len(x) else [], dtype=float)

        return df.withColumn("raw", F.when(_usable(list(self.features)), score(F.array(*_scaled(self.scaling)))))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add score; rows without any feature get NULL."""
        return self.raw(df).withColumn("score", squash("raw", self.centre, self.scale)).drop("raw")


def fit(train: DataFrame, features: list[str], model: str = "forest", **options) -> Forest | Logistic:
    """Fit a model by name, forest or logistic; options are those of its own function."""
    if model not in ("forest", "logistic"):
        raise ValueError(f"no such model: {model}; forest or logistic")
    return fit_forest(train, features, **options) if model == "forest" else fit_logistic(train, features, **options)


def fit_forest(train: DataFrame, features: list[str], seed: int = 7, trees: int = TREES, rows: int = ROWS) -> Forest:
    """Fit on the rows of `train` that have a feature, `rows` a tree; sorted feature names fix the column order."""
    per_tree = rows
    features = sorted(features)
    rows = train.where(_usable(features))
    scaling = _scaling(rows, features)
    # The rows whose key has the lowest hash, then in an order of their own: a sample of fixed size, whatever the order or
    # the partitions. Rows without a key go by their values.
    key = F.xxhash64(*[k for k in ("symbol", "ts") if k in rows.columns] or ["x"])
    sample = rows.withColumn("x", F.array(*_scaled(scaling))).select("x", key.alias("h")).orderBy("h", "x").limit(trees * per_tree)
    sample = sample.orderBy(F.xxhash64("x"), "x").toPandas()
    if sample.empty:
        raise ValueError("no training row has a feature")
    grown, size = grow(np.stack(sample["x"].to_numpy()), trees, np.random.default_rng(seed), per_tree)
    model = Forest(tuple(features), scaling, grown, size)
    c = model.raw(rows).agg(F.median("raw").alias("c"), (F.percentile("raw", F.lit(0.75)) - F.percentile("raw", F.lit(0.25))).alias("q"), F.stddev_pop("raw").alias("s")).first()
    return Forest(tuple(features), scaling, grown, size, c["c"], c["q"] if c["q"] > 1e-12 else c["s"] or 1.0)


@dataclass(frozen=True)
class Logistic:
    """A fitted logistic regression on scaled features."""

    features: tuple[str, ...]
    scaling: dict[str, tuple[float, float, float]]
    weights: tuple[float, ...]
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        """Add score; rows without any feature get NULL."""
        z = F.lit(self.intercept)
        for w, x in zip(self.weights, _scaled(self.scaling), strict=True):
            z = z + w * x
        return df.withColumn("score", F.when(_usable(list(self.features)), 1 / (1 + F.exp(-z))))


def fit_logistic(train: DataFrame, features: list[str], label: str = "label", iterations: int = 1000, penalty: float = 1.0) -> Logistic:
    """Fit with classes of equal weight in sum and an L2 penalty."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    features = sorted(features)
    rows = train.where(_usable(features))
    scaling = _scaling(rows, features)
    rows = rows.where(F.col(label).isNotNull())
    counts = {int(r["y"]): r["n"] for r in rows.groupBy(F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        raise ValueError("no training row has a label and a feature")
    n = sum(counts.values())
    y = F.col(label).cast("int")
    weight = F.when(y == 1, n / (2 * counts.get(1, 1))).otherwise(n / (2 * counts.get(0, 1)))
    data = rows.select(array_to_vector(F.array(*_scaled(scaling))).alias("x"), y.cast("double").alias("y"), weight.alias("w"))
    m = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=iterations, regParam=penalty / n, standardization=False).fit(data)
    return Logistic(tuple(features), scaling, tuple(m.coefficients.toArray().tolist()), float(m.intercept))
