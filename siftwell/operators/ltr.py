"""Learning to rank on candidate rows: balanced logistic regression and a small list-wise network."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Logistic:
    """A fitted head: prediction is a plain column expression."""

    names: tuple[str, ...]
    coef: tuple[float, ...]
    bias: float
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def probability(self) -> Column:
        z = F.lit(self.bias)
        for n, c, m, s in zip(self.names, self.coef, self.mean, self.scale):
            z = z + c * ((F.col(n) - m) / s)
        return 1.0 / (1.0 + F.exp(-z))


def fit_logistic(rows: DataFrame, names: Sequence[str], label: str = "label", l2: float = 1.0, balanced: bool = True, rounds: int = 300) -> Logistic:
    """Minimises sum of c_i * log-loss + l2 / 2 * |w|^2 (bias free), c balancing the classes, on features
    scaled by their mean and population deviation. Distributed: MLlib divides its loss by the summed
    weights, so the penalty is l2 / sum(c). Rows of one class have no least loss: the head is the limit, no
    weights and an infinite bias, so each row's probability is that class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = rows.select(label, *names).persist()  # the fit passes over them many times
    stats = rows.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("pos"), *[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    n, pos = stats["n"], stats["pos"] or 0.0
    if not n:
        rows.unpersist()
        raise ValueError("rows are needed")
    mean = tuple(float(stats[f"m_{c}"]) for c in names)
    scale = tuple(float(stats[f"s_{c}"]) or 1.0 for c in names)
    if pos in (0, n):
        rows.unpersist()
        warnings.warn("rows of one class: the head scores them all alike", stacklevel=2)
        return Logistic(tuple(names), (0.0,) * len(names), float("inf") if pos else float("-inf"), mean, scale)
    weight = F.when(F.col(label) == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))) if balanced else F.lit(1.0)
    scaled = rows.select(F.col(label).cast("double").alias("label"), weight.alias("__c"), *[((F.col(c) - m) / s).alias(c) for c, m, s in zip(names, mean, scale)])
    table = VectorAssembler(inputCols=list(names), outputCol="__x").transform(scaled)
    model = LogisticRegression(featuresCol="__x", labelCol="label", weightCol="__c", regParam=l2 / n, elasticNetParam=0.0, standardization=False, maxIter=rounds, tol=1e-9).fit(table)
    rows.unpersist()
    return Logistic(tuple(names), tuple(float(v) for v in model.coefficients), float(model.intercept), mean, scale)


def predict(rows: DataFrame, head: Logistic, keys: Sequence[str] = ("query_id", "article_id")) -> DataFrame:
    return rows.select(*keys, head.probability().alias("score"))


def predict_blend(rows: DataFrame, head: Logistic) -> DataFrame:
    """Candidates score 1 + probability, so they stand above all others (0)."""
    return rows.select("query_id", "article_id", (1 + head.probability()).alias("score"))


def out_of_fold(rows: DataFrame, folds: DataFrame, names: Sequence[str], blend: bool = False, **how) -> DataFrame:
    """Each fold's rows scored by a head fitted on the others (one small fit a fold)."""
    keyed = rows.join(folds.select("query_id", "fold"), "query_id")
    done = None
    for f in [r.fold for r in folds.select("fold").distinct().orderBy("fold").collect()]:
        head = fit_logistic(keyed.where(F.col("fold") != f), names, **how)
        part = (predict_blend if blend else predict)(keyed.where(F.col("fold") == f), head)
        done = part if done is None else done.unionByName(part)
    return done


class ListwiseNetwork:
    """A small network per candidate row trained list-wise: softmax cross-entropy over each query's
    candidates, full-batch AdamW; queries without a positive are skipped; output sigmoid(logit). The
    training rows (candidates of labelled queries) are bounded by the caller and live on the driver."""

    def __init__(self, hidden: Sequence[int] = (32, 16), epochs: int = 300, rate: float = 1e-2, decay: float = 1e-3, seed: int = 42):
        self.hidden, self.epochs, self.rate, self.decay, self.seed = tuple(hidden), epochs, rate, decay, seed

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        acts = [x]
        for k, (w, b) in enumerate(self.layers):
            z = acts[-1] @ w + b
            acts.append(np.maximum(z, 0) if k < len(self.layers) - 1 else z)
        return acts

    def fit(self, x: np.ndarray, y: np.ndarray, groups: np.ndarray) -> ListwiseNetwork:
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
        order = np.argsort(groups, kind="stable")
        x, y, groups = (x[order] - self.mean) / self.scale, np.asarray(y, float)[order], groups[order]
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.array([], int)
        own = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(groups)]))
        n_pos = np.add.reduceat(y, starts) if len(starts) else np.array([])
        live = n_pos > 0
        sizes = [x.shape[1], *self.hidden, 1]
        self.layers = [[rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)] for a, b in zip(sizes, sizes[1:])]
        m = [[np.zeros_like(p) for p in layer] for layer in self.layers]
        v = [[np.zeros_like(p) for p in layer] for layer in self.layers]
        for t in range(1, self.epochs + 1 if live.any() else 1):
            acts = self._forward(x)
            z = acts[-1][:, 0]
            e = np.exp(z - np.maximum.reduceat(z, starts)[own])
            p = e / np.add.reduceat(e, starts)[own]
            grad = np.where(live[own], p - y / np.maximum(n_pos, 1)[own], 0) / live.sum()
            delta = grad[:, None]
            for k in range(len(self.layers) - 1, -1, -1):
                w, b = self.layers[k]
                grads = (acts[k].T @ delta, delta.sum(axis=0))
                if k:
                    delta = (delta @ w.T) * (acts[k] > 0)
                for i, g in enumerate(grads):
                    m[k][i] = 0.9 * m[k][i] + 0.1 * g
                    v[k][i] = 0.999 * v[k][i] + 0.001 * g * g
                    step = (m[k][i] / (1 - 0.9**t)) / (np.sqrt(v[k][i] / (1 - 0.999**t)) + 1e-8)
                    self.layers[k][i] = self.layers[k][i] * (1 - self.rate * self.decay) - self.rate * step
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self._forward((x - self.mean) / self.scale)[-1][:, 0]))
