"""The answer table: one space-joined list of ids a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_answers(ranked: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, answer): at most k ids in rank order; a query without a ranking has an empty answer."""
    lists = ranked.where(F.col("rank") < k).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "article_id"))), lambda x: x["article_id"].cast("string")), " ").alias("answer"))
    return queries.select("query_id").distinct().join(lists, "query_id", "left").select("query_id", F.coalesce("answer", F.lit("")).alias("answer"))


def answer_profile(answers: DataFrame) -> DataFrame:
    """One row: smallest, median and largest number of ids."""
    n = F.size(F.filter(F.split("answer", " "), lambda x: x != ""))
    return answers.agg(F.min(n).cast("bigint").alias("min_ids"), F.percentile(n, F.lit(0.5)).alias("median_ids"), F.max(n).cast("bigint").alias("max_ids"))


def render_titles(pairs: DataFrame, articles: DataFrame, separator: str = " | ") -> DataFrame:
    """(query_id, titles): "id: title" of each ranked article, in order."""
    rows = pairs.join(articles.select("article_id", "title"), "article_id")
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "article_id", "title"))), lambda x: F.concat(x["article_id"].cast("string"), F.lit(": "), x["title"])), separator).alias("titles"))
