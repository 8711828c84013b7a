"""Ranking and per-query normalisation over long score tables (query_id, article_id, score[, source]).

Scores are compared after rounding to ``DIGITS`` decimals, then by ascending id, so summation order
never decides a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6
BROADCAST_GROUPS = 500_000


def few(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; a shuffled join serves otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def best_first(score: str = "score", ident: str = "article_id") -> list[Column]:
    return [F.round(F.col(score), DIGITS).desc(), F.col(ident).asc()]


def with_rank(scores: DataFrame, by: tuple[str, ...] = ("query_id",), score: str = "score", ident: str = "article_id") -> DataFrame:
    """Adds ``rank`` from 0."""
    return scores.withColumn("rank", (F.row_number().over(Window.partitionBy(*by).orderBy(*best_first(score, ident))) - 1).cast("bigint"))


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), score: str = "score", ident: str = "article_id") -> DataFrame:
    """The k best rows of each group, with ``rank``; k <= 0 gives none. The filter on row_number plans a
    group limit below the shuffle."""
    if k <= 0:
        return with_rank(scores, by, score, ident).where(F.lit(False))
    order = Window.partitionBy(*by).orderBy(*best_first(score, ident))
    return scores.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).withColumn("rank", (F.col("__n") - 1).cast("bigint")).drop("__n")


def rankings(ranked: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """One row a group: ``article_ids`` in rank order."""
    return ranked.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "article_id"))), lambda x: x["article_id"]).alias("article_ids"))


def retrieval_frame(scores: DataFrame, k: int, source: str) -> DataFrame:
    return top_k(scores, k).select("query_id", "article_id", "score", "rank", F.lit(source).alias("source"))


def _with_stats(scores: DataFrame, by: tuple[str, ...], *stats: Column) -> DataFrame:
    """Each row beside its group's statistics. They are partial sums and one row a group, which joins back
    broadcast or, beyond the bound, shuffled: no group has to fit into one task."""
    return scores.join(few(scores.groupBy(*by).agg(*stats), BROADCAST_GROUPS), list(by))


def minmax(scores: DataFrame, n_articles: int | None = None, by: tuple[str, ...] = ("query_id",), out: str = "norm") -> DataFrame:
    """Min-max per group; a constant group gives 0. ``n_articles``: articles in all - when a group lists
    fewer, the others score 0 and count in the minimum and maximum."""
    wide = _with_stats(scores, by, F.min("score").alias("__lo"), F.max("score").alias("__hi"), F.count("*").alias("__n"))
    low, high = F.col("__lo"), F.col("__hi")
    if n_articles is not None:
        partial = F.col("__n") < n_articles
        low, high = F.when(partial, F.least(low, F.lit(0.0))).otherwise(low), F.when(partial, F.greatest(high, F.lit(0.0))).otherwise(high)
    return wide.withColumn(out, F.coalesce((F.col("score") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))).select(*scores.columns, out)


def reciprocal_rank(scores: DataFrame, by: tuple[str, ...] = ("query_id",), out: str = "rr") -> DataFrame:
    return with_rank(scores, by).withColumn(out, 1.0 / (F.col("rank") + 1)).drop("rank")


def zscore(scores: DataFrame, by: tuple[str, ...] = ("query_id",), out: str = "z") -> DataFrame:
    wide = _with_stats(scores, by, F.avg("score").alias("__mean"), F.stddev_pop("score").alias("__sd"))
    return wide.withColumn(out, (F.col("score") - F.col("__mean")) / (F.col("__sd") + 1e-6)).select(*scores.columns, out)


def margins(scores: DataFrame) -> DataFrame:
    """(query_id, margin): lead of the first over the second, in units of the span (1 if the span is 0);
    0 for a lone candidate."""
    ranked = with_rank(scores)
    first, second = (F.max(F.when(F.col("rank") == r, F.col("score"))) for r in (0, 1))
    span = first - F.min("score")
    return ranked.groupBy("query_id").agg(F.coalesce((first - second) / F.when(span == 0, 1.0).otherwise(span), F.lit(0.0)).alias("margin"))


def keep_latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def popularity(frequencies: DataFrame, articles: DataFrame, k: int) -> DataFrame:
    """The k most frequent articles of the corpus (ties by id), with rank: one global top-k."""
    known = articles.join(frequencies, "article_id", "left").select("article_id", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq"))
    best = known.orderBy(F.desc("freq"), "article_id").limit(k)
    return best.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("freq"), "article_id")) - 1).cast("bigint"))  # k rows


def popularity_rerank(candidates: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Candidates (query_id, article_id, rank) re-ordered by frequency, then by their rank."""
    joined = candidates.join(frequencies, "article_id", "left").withColumn("freq", F.coalesce("freq", F.lit(0)).cast("bigint"))
    order = Window.partitionBy("query_id").orderBy(F.desc("freq"), "rank")
    return joined.withColumn("new_rank", (F.row_number().over(order) - 1).cast("bigint")).select("query_id", "article_id", "freq", F.col("new_rank").alias("rank"))
