"""Table contracts: each check returns counted violations as one row a rule; ``enforce`` raises on any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks its contract."""


def need_columns(df: DataFrame, columns: list[str], name: str = "table") -> DataFrame:
    """The table itself; raises at plan time if columns are missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"{name}: missing columns {missing}")
    return df


def _rule(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")


def _all(rules: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def score_violations(scores: DataFrame, articles: DataFrame) -> DataFrame:
    """Scores are finite, pairs unique, articles known."""
    bad_score = scores.where(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")))
    return _all([
        _rule("finite_scores", bad_score),
        _rule("unique_pairs", scores.groupBy("query_id", "article_id").count().where("count > 1")),
        _rule("known_articles", scores.join(articles.select("article_id"), "article_id", "left_anti")),
    ])


def retrieval_violations(frame: DataFrame, articles: DataFrame) -> DataFrame:
    """Pairs unique, articles known, ranks exactly 0..n-1 within a query."""
    need_columns(frame, ["query_id", "article_id", "score", "rank", "source"], "retrieval frame")
    ranks = frame.groupBy("query_id").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count("*").alias("n"), F.countDistinct("rank").alias("d"))
    return _all([
        _rule("unique_pairs", frame.groupBy("query_id", "article_id").count().where("count > 1")),
        _rule("known_articles", frame.join(articles.select("article_id"), "article_id", "left_anti")),
        _rule("dense_ranks", ranks.where("lo <> 0 OR hi <> n - 1 OR d <> n")),
    ])


def answer_violations(answer: DataFrame, queries: DataFrame, articles: DataFrame, most: int = 10) -> DataFrame:
    """Every expected query once and no other; 1..most distinct known ids in each answer."""
    if answer.columns != ["query_id", "answer"]:
        raise ContractError(f"answer: columns are {answer.columns}")
    ids = F.filter(F.split(F.coalesce("answer", F.lit("")), " "), lambda x: x != "")
    rows = answer.select("query_id", ids.alias("ids"))
    single = rows.select(F.explode("ids").alias("a")).select(F.col("a").try_cast("bigint").alias("article_id"))
    return _all([
        _rule("unique_queries", answer.groupBy("query_id").count().where("count > 1")),
        _rule("missing_queries", queries.select("query_id").join(answer, "query_id", "left_anti")),
        _rule("extra_queries", answer.join(queries.select("query_id"), "query_id", "left_anti")),
        _rule("empty_answers", rows.where(F.size("ids") == 0)),
        _rule("long_answers", rows.where(F.size("ids") > most)),
        _rule("repeated_ids", rows.where(F.size(F.array_distinct("ids")) < F.size("ids"))),
        _rule("unknown_ids", single.join(articles.select("article_id"), "article_id", "left_anti")),
    ])


def enforce(violations: DataFrame) -> None:
    broken = {r.rule: r.violations for r in violations.where("violations > 0").collect()}  # one row a rule
    if broken:
        raise ContractError(str(broken))


def same_pairs(sources: dict[str, DataFrame]) -> DataFrame:
    """(source, missing): how many pairs of the union each source lacks; aligned sources lack none."""
    tagged = reduce(DataFrame.unionByName, [df.select("query_id", "article_id", F.lit(n).alias("source")) for n, df in sources.items()])
    every = tagged.select("query_id", "article_id").distinct().agg(F.count("*").alias("n"))
    own = tagged.distinct().groupBy("source").agg(F.count("*").alias("own"))
    return own.crossJoin(F.broadcast(every)).select("source", (F.col("n") - F.col("own")).alias("missing"))
