import pytest
from pyspark.sql import functions as F

from siftwell.operators import diagnostics, rerank, tuning


@pytest.fixture(scope="module")
def toy(spark):
    n = 12
    q = spark.createDataFrame([(i, f"word{i} common") for i in range(n)], "query_id bigint, query_text string")
    cand = spark.createDataFrame([(i, (i + d) % n, d) for i in range(n) for d in range(6)], "query_id bigint, article_id bigint, rank bigint")
    passages = cand.select("query_id", "article_id", F.concat(F.lit("text of word"), F.col("article_id").cast("string"), F.lit(" common")).alias("passage"))
    labels = spark.createDataFrame([(i, i) for i in range(n)], "query_id bigint, article_id bigint")
    folds = spark.createDataFrame([(i, i % 3) for i in range(n)], "query_id bigint, fold int")
    return q, cand, passages, labels, folds


def test_fold_models_beat_chance_and_reload(spark, toy, tmp_path):
    q, cand, passages, labels, folds = toy
    scores, heads = tuning.fold_scores(cand, passages, q, labels, folds, n_negatives=3)
    assert set(heads) == {0, 1, 2} and scores.count() == 3 * cand.count()
    oof = tuning.own_fold(scores, folds)
    assert tuning.audit(oof, labels, q, 1.0) == 1.0
    with pytest.raises(AssertionError):
        tuning.audit(oof, labels, q, 0.5)
    flat = cand.select("query_id", "article_id", F.lit(0.0).alias("score"))
    assert tuning.accepted(oof, flat, labels, q) and not tuning.accepted(oof, oof, labels, q)
    assert tuning.mean_of_folds(scores).count() == cand.count()
    tuning.save_head(spark, str(tmp_path / "head.json"), heads[0])
    back = tuning.load_head(spark, str(tmp_path / "head.json"))
    assert back == heads[0] and max(tuning.drift(back, heads[0]).values()) == 0


def test_synthetic_groups_know_their_articles(spark, toy):
    q, cand, passages, _, _ = toy
    synthetic = spark.createDataFrame([(0, "0 999"), (1, "777")], "query_id bigint, ground_truth string")
    articles = cand.select("article_id").distinct()
    rows = tuning.synthetic_groups(synthetic, articles, cand, passages, 3).collect()
    assert [(r.query_id, r.positive_id) for r in rows] == [(0, 0)]


def test_variants_keep_their_candidates(spark, toy):
    q, cand, passages, _, _ = toy
    v = q.select("query_id", F.lit("original").alias("variant"), "query_text")
    assert tuning.score_variants(v, cand, passages, limit=2).count() == 12
    with pytest.raises(ValueError):
        tuning.score_variants(v, cand, passages, mode="anew")


def test_holdout_refit(spark, toy):
    q, cand, passages, labels, folds = toy
    rows = rerank.rerank(cand, passages, q).withColumn("rr", F.rand(1))
    head = tuning.refit_on(rows, labels, folds.where("fold = 0"), ("score", "rr"))
    assert head.coef[0] > 0


def test_bins_and_layout(spark):
    per = spark.createDataFrame([(i, 1.0 if i % 2 else 0.0) for i in range(40)], "query_id bigint, ap double")
    bins = per.select("query_id", F.when(F.col("query_id") < 20, "a").otherwise("b").alias("bin"))
    got = diagnostics.bin_intervals(per, bins, resamples=500)
    assert set(got) == {"a", "b"} and got["a"][0] < 0.5 < got["a"][1]
    assert spark.range(1).select(F.lit(0).alias("hops")).select(diagnostics.disc_radius().alias("r")).first().r == 0
