"""Ranking quality. Predictions: (query_id, article_id, rank); labels: (query_id, article_id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hits(ranked: DataFrame, labels: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Predictions with ``hit``: the first sight of each relevant article counts, repeats keep their place."""
    first = Window.partitionBy(*by, "article_id").orderBy("rank")
    marked = ranked.join(labels.select("query_id", "article_id").distinct().withColumn("__rel", F.lit(1)), ["query_id", "article_id"], "left")
    return marked.withColumn("hit", F.when((F.row_number().over(first) == 1) & F.col("__rel").isNotNull(), 1).otherwise(0)).drop("__rel")


def per_query(ranked: DataFrame, labels: DataFrame, queries: DataFrame, k: int = 10, recall_ks: Sequence[int] = (10,), by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(by..., n_rel, ap, recall_k..., first_rank): one row a labelled or unlabelled query; queries without
    labels or predictions score 0; first_rank is 999 if nothing relevant was predicted.

    ``by`` may add keys (a variant, a weight vector): then ``queries`` must hold them too."""
    rel = labels.select("query_id", "article_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_rel"))
    run = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scored = hits(ranked, labels, by).withColumn("prec", F.sum("hit").over(run) / (F.col("rank") + 1))
    sums = scored.groupBy(*by).agg(
        F.sum(F.when(F.col("rank") < k, F.col("hit") * F.col("prec")).otherwise(0.0)).alias("s"),
        *[F.sum(F.when(F.col("rank") < r, F.col("hit")).otherwise(0)).alias(f"h{r}") for r in recall_ks],
        F.min(F.when(F.col("hit") == 1, F.col("rank") + 1)).alias("first"),
    )
    full = queries.select(*by).distinct().join(rel, "query_id", "left").join(sums, list(by), "left")
    n = F.coalesce("n_rel", F.lit(0))
    zero = lambda x: F.when(n > 0, F.coalesce(x, F.lit(0.0))).otherwise(0.0)
    return full.select(
        *by,
        n.cast("bigint").alias("n_rel"),
        zero(F.col("s") / F.nullif(F.least(n, F.lit(k)), F.lit(0))).alias("ap"),
        *[zero(F.col(f"h{r}") / F.nullif(n, F.lit(0))).alias(f"recall_{r}") for r in recall_ks],
        F.coalesce("first", F.lit(999)).cast("bigint").alias("first_rank"),
    )


def summary(scored: DataFrame, recall_ks: Sequence[int] = (10,), by: tuple[str, ...] = ()) -> DataFrame:
    """Mean AP and recalls over all queries."""
    cols = [F.count("*").alias("n_queries"), F.round(F.avg("ap"), 6).alias("map"), *[F.round(F.avg(f"recall_{r}"), 6).alias(f"recall_{r}") for r in recall_ks]]
    return scored.groupBy(*by).agg(*cols) if by else scored.agg(*cols)
