import pytest
from pyspark.sql import functions as F

from siftwell.operators import answers, contracts, metrics, rank, splits, stats

SCORES = "query_id bigint, article_id bigint, score double"


def scores(spark, rows):
    return spark.createDataFrame(rows, SCORES)


def ids(df):
    return [r.article_id for r in df.orderBy("query_id", "rank").collect()]


def test_top_k_ties_go_to_the_smaller_id(spark):
    assert ids(rank.top_k(scores(spark, [(1, 10, 0.1), (1, 20, 0.5), (1, 30, 0.5), (1, 40, 0.2)]), 3)) == [20, 30, 40]
    assert ids(rank.top_k(scores(spark, [(1, 7, 0.3), (1, 3, 0.3), (1, 5, 0.3)]), 9)) == [3, 5, 7]
    assert ids(rank.top_k(scores(spark, [(1, 7, 0.3)]), 0)) == []


def test_top_k_plans_a_group_limit(spark):
    plan = rank.top_k(scores(spark, [(1, 7, 0.3)]), 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_minmax(spark):
    got = {(r.query_id, r.article_id): r.norm for r in rank.minmax(scores(spark, [(1, 1, 0.0), (1, 2, 5.0), (1, 3, 10.0), (2, 1, 2.0), (2, 2, 2.0), (2, 3, 2.0)])).collect()}
    assert got == {(1, 1): 0, (1, 2): 0.5, (1, 3): 1, (2, 1): 0, (2, 2): 0, (2, 3): 0}
    sparse = {r.article_id: r.norm for r in rank.minmax(scores(spark, [(1, 1, 2.0), (1, 2, 4.0)]), 3).collect()}
    assert sparse == {1: 0.5, 2: 1.0}


def test_reciprocal_rank_and_margin(spark):
    s = scores(spark, [(1, 1, 0.1), (1, 2, 0.9), (1, 3, 0.5), (2, 1, 4.0)])
    assert {(r.query_id, r.article_id): round(r.rr, 6) for r in rank.reciprocal_rank(s).collect()} == {(1, 1): round(1 / 3, 6), (1, 2): 1, (1, 3): 0.5, (2, 1): 1}
    assert {r.query_id: round(r.margin, 6) for r in rank.margins(s).collect()} == {1: 0.5, 2: 0}


def ap(spark, predicted, relevant, k=10, ks=(10,)):
    ranked = spark.createDataFrame([(1, a, i) for i, a in enumerate(predicted)] or [], "query_id bigint, article_id bigint, rank bigint")
    labels = spark.createDataFrame([(1, a) for a in relevant], "query_id bigint, article_id bigint")
    return metrics.per_query(ranked, labels, spark.createDataFrame([(1,)], "query_id bigint"), k, ks).first()


@pytest.mark.parametrize(
    "predicted,relevant,k,want",
    [([1, 9, 2, 8, 7], {1, 2}, 10, (1 + 2 / 3) / 2), ([9, 1, 3], {1}, 10, 0.5), ([1, 2, 3], {1, 2, 3}, 2, 1.0), ([*range(1, 11), 99], {99}, 10, 0.0), ([1, 1, 2], {1, 2}, 10, (1 + 2 / 3) / 2), ([], {1}, 10, 0.0), ([1], set(), 10, 0.0)],
)
def test_average_precision(spark, predicted, relevant, k, want):
    assert abs(ap(spark, predicted, relevant, k).ap - want) < 1e-12


def test_recall_and_first_rank(spark):
    assert ap(spark, [1, 9, 8], {1, 2}, ks=(3,)).recall_3 == 0.5
    row = ap(spark, [9, 1, 2], {1, 2}, ks=(1,))
    assert row.recall_1 == 0 and row.first_rank == 2
    assert ap(spark, [9], {1}).first_rank == 999


def test_contracts(spark):
    articles = spark.createDataFrame([(1,), (2,)], "article_id bigint")
    bad = scores(spark, [(1, 1, float("nan")), (1, 5, 0.1), (1, 2, 0.2), (1, 2, 0.3)])
    assert {r.rule: r.violations for r in contracts.score_violations(bad, articles).collect()} == {"finite_scores": 1, "unique_pairs": 1, "known_articles": 1}
    with pytest.raises(contracts.ContractError):
        contracts.enforce(contracts.score_violations(bad, articles))
    gap = spark.createDataFrame([(1, 1, 0.5, 0, "s"), (1, 2, 0.4, 2, "s")], "query_id bigint, article_id bigint, score double, rank bigint, source string")
    assert {r.rule: r.violations for r in contracts.retrieval_violations(gap, articles).collect()}["dense_ranks"] == 1
    with pytest.raises(contracts.ContractError):
        contracts.need_columns(articles, ["query_id"])


def test_answers(spark):
    ranked = spark.createDataFrame([(1, 10 * (i + 1), i) for i in range(12)], "query_id bigint, article_id bigint, rank bigint")
    queries = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    got = {r.query_id: r.answer for r in answers.build_answers(ranked, queries).collect()}
    assert got[1].split()[:3] == ["10", "20", "30"] and len(got[1].split()) == 10 and got[2] == ""
    articles = spark.createDataFrame([(10,)], "article_id bigint")
    bad = spark.createDataFrame([(1, "10 10 x"), (3, "")], "query_id bigint, answer string")
    found = {r.rule: r.violations for r in contracts.answer_violations(bad, queries, articles, 2).collect()}
    assert found == {"unique_queries": 0, "missing_queries": 1, "extra_queries": 1, "empty_answers": 1, "long_answers": 1, "repeated_ids": 1, "unknown_ids": 1}


def test_splits(spark):
    counts = {i: 1 if i < 60 else 2 if i < 90 else 3 for i in range(100)}
    seeded = splits.seeded_splits(counts)
    assert sum(f is None for f in seeded.values()) == 20 and sorted({f for f in seeded.values() if f is not None}) == [0, 1, 2, 3, 4]
    assert seeded == splits.seeded_splits(counts)
    table = spark.createDataFrame(list(counts.items()), "query_id bigint, n_labels bigint")
    rows = splits.hash_splits(table).collect()
    assert sum(r.split == "holdout" for r in rows) == 20 and all((r.fold is None) == (r.split == "holdout") for r in rows)
    sizes = [r.n for r in splits.fold_sizes(splits.hash_splits(table)).where("fold is not null").collect()]
    assert sum(sizes) == 80 and max(sizes) - min(sizes) <= 3


def test_resampling():
    import numpy as np

    low, high = stats.bootstrap_ci(np.array([0.0, 1.0] * 50), 2000)
    assert 0.38 < low < 0.5 < high < 0.62
    assert stats.bootstrap_ci(np.array([])) == (0.0, 0.0)
    assert stats.permutation_p(np.ones(20), np.zeros(20), 999) < 0.01
    assert stats.permutation_p(np.ones(5), np.ones(5), 99) == 1.0 and stats.permutation_p(np.array([]), np.array([])) == 1.0
    with pytest.raises(ValueError):
        stats.permutation_p(np.ones(2), np.ones(3))


def test_distributed_bootstrap_agrees(spark):
    df = spark.range(200).select(F.col("id").alias("query_id"), (F.col("id") % 2).cast("double").alias("ap"))
    row = stats.interval(stats.bootstrap_table(df, "ap", 300)).first()
    assert 0.4 < row.low < 0.5 < row.high < 0.6
