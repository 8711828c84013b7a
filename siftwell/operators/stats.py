"""Resampling statistics over per-query values (a metric table: thousands of rows at most)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_VALUES = 1_000_000


def values(df: DataFrame, *cols: str) -> np.ndarray:
    """Columns of a per-query table in the order of query_id; refuses tables that are no such table."""
    rows = df.select("query_id", *cols).orderBy("query_id").limit(MOST_VALUES + 1).collect()
    if len(rows) > MOST_VALUES:
        raise ValueError("too many values for a resampling on the driver; use bootstrap_table")
    return np.array([[float(r[c]) for c in cols] for r in rows], float).reshape(len(rows), len(cols))


def bootstrap_ci(x: np.ndarray, resamples: int = 10_000, level: float = 0.95, seed: int = 42) -> tuple[float, float]:
    """Percentile interval of the mean; (0, 0) of nothing."""
    x = np.asarray(x, float)
    if not len(x):
        return 0.0, 0.0
    rng = np.random.default_rng(seed)
    means = np.concatenate([x[rng.integers(0, len(x), size=(min(1000, resamples - lo), len(x)))].mean(axis=1) for lo in range(0, resamples, 1000)])
    tail = (1 - level) / 2
    return float(np.quantile(means, tail)), float(np.quantile(means, 1 - tail))


def permutation_p(a: np.ndarray, b: np.ndarray, resamples: int = 10_000, seed: int = 42) -> float:
    """Two-sided paired sign-flip test of the mean difference, (count + 1) / (resamples + 1); 1 of nothing."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if a.shape != b.shape:
        raise ValueError("paired values have different shapes")
    if not len(a):
        return 1.0
    d = a - b
    seen, rng, count = abs(d.mean()), np.random.default_rng(seed), 0
    for lo in range(0, resamples, 1000):
        signs = rng.choice([-1.0, 1.0], size=(min(1000, resamples - lo), len(d)))
        count += int((np.abs((signs * d).mean(axis=1)) >= seen - 1e-12).sum())
    return (count + 1) / (resamples + 1)


def bootstrap_table(df: DataFrame, value: str, resamples: int = 200, seed: int = 42) -> DataFrame:
    """(resample, mean): distributed Poisson bootstrap - each row joins each resample Poisson(1) times,
    drawn from a hash of (seed, query, resample), so no row leaves its partition before the sums."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "query_id", "resample"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cum, term, times = 0.0, float(np.exp(-1)), F.lit(0)
    for k in range(8):
        cum += term
        times = times + (u > cum).cast("int")
        term /= k + 1
    rows = df.select("query_id", F.col(value).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")).withColumn("c", times)
    return rows.groupBy("resample").agg((F.sum(F.col("c") * F.col("x")) / F.nullif(F.sum("c"), F.lit(0))).alias("mean"))


def interval(boot: DataFrame, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return boot.agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))
