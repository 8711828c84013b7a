"""Fusion of score sources: weighted min-max sums, reciprocal ranks, logistic features, weight search.

A source is a long table (query_id, article_id, score). Absent pairs score 0: min-max sees them through
``n_articles``, and pairs that no source lists are never materialised.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators import metrics, rank
from siftwell.operators.graph import ensure_checkpoints


def tag(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All sources in one table with column ``source``."""
    return reduce(DataFrame.unionByName, [df.select("query_id", "article_id", F.col("score").cast("double").alias("score"), F.lit(n).alias("source")) for n, df in sources.items()])


def normalised(sources: Mapping[str, DataFrame], n_articles: int | None = None) -> DataFrame:
    """Min-max per source and query. Scores are read twice (statistics, then rows), so they are written first."""
    rows = tag(sources)
    ensure_checkpoints(rows.sparkSession)
    return rank.minmax(rows.checkpoint(), n_articles, by=("source", "query_id"))


def weighted_sum(sources: Mapping[str, DataFrame], weights: Mapping[str, float], n_articles: int | None = None, normalise: bool = True) -> DataFrame:
    """sum of weight * min-max score; a source without weight counts 0."""
    rows = normalised(sources, n_articles) if normalise else tag(sources).withColumn("norm", F.col("score"))
    w = reduce(lambda acc, nw: acc.when(F.col("source") == nw[0], F.lit(float(nw[1]))), weights.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    return rows.groupBy("query_id", "article_id").agg(F.sum(w * F.col("norm")).alias("score"))


def reciprocal_rank_fusion(sources: Mapping[str, DataFrame], k: int = 60) -> DataFrame:
    """sum of 1 / (k + rank), ranks from 1, over the sources that list the pair."""
    ranked = rank.with_rank(tag(sources), by=("source", "query_id"))
    return ranked.groupBy("query_id", "article_id").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"))


def features(sources: Mapping[str, DataFrame], n_articles: int | None = None, ranks: bool = True, suffixes: tuple[str, str] = ("norm", "rr")) -> DataFrame:
    """(query_id, article_id, <source>_norm, <source>_rr ...): one grouped pass pivots all sources."""
    rows = rank.reciprocal_rank(normalised(sources, n_articles), by=("source", "query_id"))
    cols = []
    for name in sources:
        cols.append(F.coalesce(F.max(F.when(F.col("source") == name, F.col("norm"))), F.lit(0.0)).alias(f"{name}_{suffixes[0]}"))
        if ranks:
            cols.append(F.coalesce(F.max(F.when(F.col("source") == name, F.col("rr"))), F.lit(0.0)).alias(f"{name}_{suffixes[1]}"))
    return rows.groupBy("query_id", "article_id").agg(*cols)


def label_features(table: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``label``: 1 if the pair is labelled."""
    marked = labels.select("query_id", "article_id").distinct().withColumn("label", F.lit(1))
    return table.join(marked, ["query_id", "article_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def weight_samples(n_sources: int, n_samples: int, seed: int) -> np.ndarray:
    """Rows of weights: each source alone, all alike, then Dirichlet(1) samples."""
    fixed = np.vstack([np.eye(n_sources), np.full((1, n_sources), 1 / n_sources)])
    return np.vstack([fixed, np.random.default_rng(seed).dirichlet(np.ones(n_sources), size=n_samples)]) if n_samples > 0 else fixed


def weight_table(spark, names: Sequence[str], weights: np.ndarray) -> DataFrame:
    """(wid, w): one array of weights in the order of ``names`` per candidate."""
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(weights)], "wid int, w array<double>")


def evaluate_weights(sources: Mapping[str, DataFrame], labels: DataFrame, queries: DataFrame, weights: DataFrame, k: int = 10, recall_k: int = 30, n_articles: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., wid, map, recall): all weight vectors in one job; label-less queries are left out.

    ``weights`` has (wid, w) and optionally ``keys`` (a fold) that ``queries`` carries too. The blow-up is
    |weights| rows a listed pair of labelled queries, cut to the deepest needed rank by a group limit."""
    names = list(sources)
    wide = features(sources, n_articles, ranks=False)
    asked = queries.join(labels.select("query_id").distinct(), "query_id", "left_semi")
    grid = wide.join(asked, "query_id").join(F.broadcast(weights), list(keys)) if keys else wide.join(asked, "query_id").crossJoin(F.broadcast(weights))
    total = sum((F.col("w")[i] * F.col(f"{n}_norm") for i, n in enumerate(names)), F.lit(0.0))
    scored = grid.select(*keys, "wid", "query_id", "article_id", total.alias("score"))
    by = (*keys, "wid", "query_id")
    best = rank.top_k(scored, max(k, recall_k), by=by)
    return weight_quality(best, labels, queries, weights, k, recall_k, keys)


def weight_quality(best: DataFrame, labels: DataFrame, queries: DataFrame, weights: DataFrame, k: int = 10, recall_k: int = 30, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., wid, map, recall) of the first articles (keys..., wid, query_id, article_id, rank) by each weight vector."""
    asked = queries.join(labels.select("query_id").distinct(), "query_id", "left_semi")
    every = asked.join(F.broadcast(weights.select(*keys, "wid")), list(keys)) if keys else asked.crossJoin(F.broadcast(weights.select("wid")))
    per = metrics.per_query(best, labels, every, k, (recall_k,), by=(*keys, "wid", "query_id"))
    return per.groupBy(*keys, "wid").agg(F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg(f"recall_{recall_k}"), 6).alias("recall"))


def best_weights(evaluated: DataFrame, weights: DataFrame, objective: str = "map", keys: tuple[str, ...] = ()) -> DataFrame:
    """The lexicographically best (objective, other) of each key; the first wid of equal ones."""
    first, second = ("map", "recall") if objective == "map" else ("recall", "map")
    order = F.struct(F.col(first), F.col(second), -F.col("wid"))
    picked = evaluated.groupBy(*keys).agg(F.max_by("wid", order).alias("wid")) if keys else evaluated.agg(F.max_by("wid", order).alias("wid"))
    return picked.join(weights, [*keys, "wid"]).select(*keys, "wid", "w")


def replace_out_of_fold(base: DataFrame, out_of_fold: DataFrame, folds: DataFrame) -> DataFrame:
    """``base`` with the rows of all fold queries replaced by their out-of-fold rows."""
    return base.join(rank.few(folds.select("query_id"), rank.BROADCAST_GROUPS), "query_id", "left_anti").unionByName(out_of_fold)


def out_of_fold_weights(sources: Mapping[str, DataFrame], labels: DataFrame, folds: DataFrame, n_samples: int = 500, k: int = 10, recall_k: int = 30, objective: str = "map", seed: int = 42, n_articles: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores of every fold query by weights found on the other folds, chosen weights by fold): one search
    job for all folds, keyed by (fold, wid). Fold f samples with seed + f."""
    names = list(sources)
    spark = folds.sparkSession
    n_folds = folds.agg(F.max("fold")).first()[0] + 1
    tables = [weight_table(spark, names, weight_samples(len(names), n_samples, seed + f)).withColumn("fold", F.lit(f)) for f in range(n_folds)]
    weights = reduce(DataFrame.unionByName, tables)
    every = spark.range(n_folds).select(F.col("id").cast("int").alias("fold"))
    train = folds.select("query_id", F.col("fold").cast("int").alias("own")).crossJoin(F.broadcast(every)).where("own <> fold").select("query_id", "fold")
    chosen = best_weights(evaluate_weights(sources, labels, train, weights, k, recall_k, n_articles, keys=("fold",)), weights, objective, keys=("fold",))
    wide = features(sources, n_articles, ranks=False).join(folds.select("query_id", F.col("fold").cast("int").alias("fold")), "query_id").join(F.broadcast(chosen), "fold")
    total = sum((F.col("w")[i] * F.col(f"{n}_norm") for i, n in enumerate(names)), F.lit(0.0))
    return wide.select("query_id", "article_id", total.alias("score")), chosen


def ensemble(scores: DataFrame, how: str = "mean") -> DataFrame:
    """Models (fold, query_id, article_id, score) to one score: raw mean, mean z-score, or mean reciprocal rank."""
    by = ("fold", "query_id")
    if how == "mean":
        rows, col = scores, "score"
    elif how == "z":
        rows, col = rank.zscore(scores, by), "z"
    elif how == "rr":
        rows, col = rank.reciprocal_rank(scores, by), "rr"
    else:
        raise ValueError(how)
    return rows.groupBy("query_id", "article_id").agg(F.avg(col).alias("score"))


def ensemble_subsets(scores: DataFrame, n_models: int) -> DataFrame:
    """(subset, query_id, article_id, score): the raw mean of every non-empty subset of models 0..n-1 (a bit
    mask each), for a handful of models."""
    if n_models > 8:
        raise ValueError("subsets are for a handful of models")
    masks = scores.sparkSession.range(1, 2**n_models).select(F.col("id").alias("subset"))
    inside = F.expr("(subset >> cast(fold as int)) & 1 = 1")
    return scores.crossJoin(F.broadcast(masks)).where(inside).groupBy("subset", "query_id", "article_id").agg(F.avg("score").alias("score"))

