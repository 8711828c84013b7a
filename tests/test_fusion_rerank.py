import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import dense, fusion, graph, ltr, rank, rerank

SCORES = "query_id bigint, article_id bigint, score double"


def df(spark, rows, schema=SCORES):
    return spark.createDataFrame(rows, schema)


def test_rrf_prefers_consensus(spark):
    a, b = df(spark, [(1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.1)]), df(spark, [(1, 1, 0.8), (1, 3, 0.7), (1, 2, 0.1)])
    assert rank.top_k(fusion.reciprocal_rank_fusion({"a": a, "b": b}), 1).first().article_id == 1


def test_weight_search_finds_the_informative_source(spark):
    good = [(q, a, 1.0 if a == q else 0.1 * a) for q in range(6) for a in range(6)]
    bad = [(q, a, -s) for q, a, s in good]
    src = {"good": df(spark, good), "bad": df(spark, bad)}
    labels = df(spark, [(q, q) for q in range(6)], "query_id bigint, article_id bigint")
    folds = df(spark, [(q, q % 2) for q in range(6)], "query_id bigint, fold int")
    w = fusion.weight_table(spark, list(src), fusion.weight_samples(2, 5, 1))
    best = fusion.best_weights(fusion.evaluate_weights(src, labels, folds.select("query_id"), w, n_articles=6), w).first()
    assert best.w[0] > best.w[1]
    oof, chosen = fusion.out_of_fold_weights(src, labels, folds, 5, n_articles=6)
    assert oof.select("query_id").distinct().count() == 6 and chosen.count() == 2


def test_weights_are_a_simplex():
    w = fusion.weight_samples(3, 10, 0)
    assert w.shape == (14, 3) and np.allclose(w.sum(axis=1), 1) and (w[:3] == np.eye(3)).all()


def test_lexical_reranker(spark):
    rows = df(spark, [("red fox", "the red fox ran"), ("red fox", "a red car"), ("", "x"), (None, None)], "query_text string, passage string")
    assert [r.score for r in rerank.score_pairs(rows).collect()] == [1.0, 0.5, 0.0, 0.0]
    with pytest.raises(ValueError):
        rerank.build_backend("nothing")


def test_registered_backend_and_listwise(spark):
    import pandas as pd

    rerank.register_backend("length", lambda: lambda q, p: p.str.len().astype(float))
    rows = df(spark, [("q", "abc")], "query_text string, passage string")
    assert rerank.score_pairs(rows, "length").first().score == 3.0
    pairs = df(spark, [(1, 5, "q", "aa"), (1, 6, "q", "a")], "query_id bigint, article_id bigint, query_text string, passage string")
    got = {r.article_id: r.score for r in rerank.score_listwise(pairs, lambda q, ps: [float(len(p)) for p in ps]).collect()}
    assert got == {5: 2.0, 6: 1.0} and isinstance(pd.Series([1]), pd.Series)


def test_rerank_takes_the_best_chunk(spark):
    cand = df(spark, [(1, 10), (1, 20), (1, 30)], "query_id bigint, article_id bigint")
    passages = df(spark, [(1, 10, "x"), (1, 10, "red fox"), (1, 20, "red")], "query_id bigint, article_id bigint, passage string")
    q = df(spark, [(1, "red fox")], "query_id bigint, query_text string")
    assert {r.article_id: r.score for r in rerank.rerank(cand, passages, q).collect()} == {10: 1.0, 20: 0.5}


def test_blend_weight_one_is_fusion_order(spark):
    f, r = df(spark, [(1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.1)]), df(spark, [(1, 1, 0.0), (1, 2, 0.2), (1, 3, 0.9)])
    assert [x.article_id for x in rank.top_k(rerank.manual_blend(f, r, 1.0), 3).orderBy("rank").collect()] == [1, 2, 3]
    assert rerank.manual_blend(f, r, 0.5).agg(F.min("score")).first()[0] >= 1
    labels = df(spark, [(1, 3)], "query_id bigint, article_id bigint")
    grid = rerank.blend_search(f, r, labels, f.select("query_id"), 5).orderBy(F.desc("map"), "wid").first()
    assert grid.weight < 1


def test_training_groups(spark):
    cand = df(spark, [(1, 10, 0), (1, 20, 1), (1, 30, 2), (1, 40, 3)], "query_id bigint, article_id bigint, rank bigint")
    labels = df(spark, [(1, 10)], "query_id bigint, article_id bigint")
    passages = cand.select("query_id", "article_id").withColumn("passage", F.lit("p"))
    rows = rerank.training_groups(cand, labels, passages, 2).collect()
    assert [(r.positive_id, r.negative_ids) for r in rows] == [(10, [20, 30])]
    assert rerank.training_groups(cand, labels, passages, 5).count() == 0


def test_schedule(spark):
    f = [r.f for r in spark.range(100).select(rerank.schedule(F.col("id"), 100).alias("f")).collect()]
    assert f[0] == 0.1 and f[9] == 1.0 and f[10] == 1.0 and f[-1] < 0.01
    with pytest.raises(ValueError):
        rerank.schedule(F.lit(1), 10, kind="x")


def test_link_graph(spark):
    rows = df(spark, [(101, '<a href="/articles/202">x</a><a href="/articles/999">y</a><a href="/articles/101">z</a>'), (202, "")], "article_id bigint, body string")
    assert {tuple(r) for r in graph.link_edges(rows).collect()} == {(101, 202), (202, 101)}


def test_co_labels(spark):
    labels = df(spark, [(1, 10), (1, 20), (2, 10), (2, 20), (3, 10)], "query_id bigint, article_id bigint")
    assert {tuple(r) for r in graph.co_labels(labels).collect()} == {(10, 20, 2), (20, 10, 2)}
    assert {tuple(r) for r in graph.label_frequency(labels).collect()} == {(10, 3), (20, 2)}


def test_graph_features_leave_one_out(spark):
    s = df(spark, [(1, 10, 3.0), (1, 20, 2.0), (1, 30, 1.0), (99, 10, 3.0), (99, 20, 2.0), (99, 30, 1.0)])
    labels = df(spark, [(1, 10), (1, 30)], "query_id bigint, article_id bigint")
    links = df(spark, [(10, 20), (20, 10)], "src bigint, dst bigint")
    vec = df(spark, [(10, [1.0, 0.0]), (20, [0.0, 1.0]), (30, [1.0, 0.0])], "article_id bigint, vec array<double>")
    got = {(r.query_id, r.article_id): r for r in graph.graph_features(s, labels, links, vec).collect()}
    assert got[99, 30].co_top_p == 1.0 and got[1, 30].co_top_p == 0.0
    assert math.isclose(got[99, 30].gt_freq, math.log(2)) and got[1, 30].gt_freq == 0
    assert got[99, 10].link_top == 1.0 and got[99, 30].link_top == 0.0 and got[99, 30].sim_top == 1.0
    assert math.isclose(got[99, 30].co_x_margin, 0.5)


def test_components_and_distances(spark):
    e = df(spark, [(i, i + 1) for i in range(30)] + [(100, 101)], "src bigint, dst bigint")
    got = {r.node: r.root for r in graph.components(e).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100
    hops = {r.node: r.hops for r in graph.distances(df(spark, [(0, 1), (1, 2), (0, 2)], "src bigint, dst bigint"), df(spark, [(0,)], "node bigint")).collect()}
    assert hops == {0: 0, 1: 1, 2: 1}


def test_article_vectors_are_unit(spark):
    chunks = df(spark, [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [1.0, 0.0])], "article_id bigint, chunk_id int, emb array<double>")
    for r in dense.article_vectors(chunks).collect():
        assert math.isclose(sum(x * x for x in r.vec), 1)


def test_block_join_equals_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(0)
    q = df(spark, [(i, rng.normal(size=4).tolist()) for i in range(5)], "query_id bigint, emb array<double>")
    v = df(spark, [(i, 0, rng.normal(size=4).tolist()) for i in range(40)], "article_id bigint, chunk_id int, emb array<double>")
    near = {(r.query_id, r.article_id): round(r.sim, 9) for r in dense.similarities(q, v, ["article_id", "chunk_id"]).collect()}
    monkeypatch.setattr(dense, "CLOSURE_BYTES", 0)
    far = {(r.query_id, r.article_id): round(r.sim, 9) for r in dense.similarities(q, v, ["article_id", "chunk_id"]).collect()}
    assert near == far and len(near) == 200


def test_logistic_reaches_the_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.3 * rng.normal(size=400) > 1).astype(int)
    rows = df(spark, [(i, 0, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "query_id bigint, article_id bigint, a double, b double, label int")
    head = ltr.fit_logistic(rows, ("a", "b"))
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(400)]
    c = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        g = z.T @ (c * (p - y)) + np.r_[w[:2], 0]
        w -= np.linalg.solve((z * (c * p * (1 - p))[:, None]).T @ z + np.diag([1, 1, 0]), g)
    assert np.allclose([*head.coef, head.bias], w, atol=1e-3)
    got = np.array([r.score for r in ltr.predict(rows, head).orderBy("query_id").collect()])
    assert ((got > 0.5) == y).mean() > 0.8


@pytest.mark.parametrize("label", [0, 1])
def test_logistic_of_one_class_is_the_limit(spark, label):
    rows = spark.createDataFrame([(q, 1, label, 0.1 * q, 2.0) for q in range(6)], "query_id bigint, article_id bigint, label int, a double, b double")
    with pytest.warns(UserWarning, match="one class"):
        head = ltr.fit_logistic(rows, ("a", "b"))
    assert head.coef == (0.0, 0.0) and head.bias == (math.inf if label else -math.inf)
    assert {r.score for r in ltr.predict(rows, head).collect()} == {float(label)}


def test_listwise_network_learns_and_repeats():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    groups = np.repeat(np.arange(20), 10)
    y = np.zeros(200)
    for g in range(20):
        y[g * 10 + np.argmax(x[g * 10 : g * 10 + 10, 0])] = 1
    a = ltr.ListwiseNetwork((8,), 150).fit(x, y, groups).predict(x)
    assert np.array_equal(a, ltr.ListwiseNetwork((8,), 150).fit(x, y, groups).predict(x))
    assert np.mean([np.argmax(a[g * 10 : g * 10 + 10]) == np.argmax(y[g * 10 : g * 10 + 10]) for g in range(20)]) > 0.8


def test_ensemble_subsets(spark):
    s = df(spark, [(0, 1, 5, 1.0), (1, 1, 5, 3.0)], "fold int, query_id bigint, article_id bigint, score double")
    assert {r.subset: r.score for r in fusion.ensemble_subsets(s, 2).collect()} == {1: 1.0, 2: 3.0, 3: 2.0}
    with pytest.raises(ValueError):
        fusion.ensemble(s, "x")


def test_listwise_backends_see_whole_lists(spark):
    cand = spark.createDataFrame([(1, 10, 0), (1, 20, 1), (2, 10, 0)], "query_id bigint, article_id bigint, rank int")
    passages = spark.createDataFrame([(1, 10, "a"), (1, 10, "aaa"), (1, 20, "aa"), (2, 10, "aaaa"), (3, 30, "x")], "query_id bigint, article_id bigint, passage string")
    queries = spark.createDataFrame([(1, "q"), (2, "r")], "query_id bigint, query_text string")
    rerank.register_listwise("longest_first", lambda: lambda q, ps: [len(p) / sum(map(len, ps)) for p in ps])
    try:
        got = {(r.query_id, r.article_id): round(r.score, 6) for r in rerank.rerank(cand, passages, queries, "longest_first").collect()}
    finally:
        rerank.LISTWISE.pop("longest_first")
    assert got == {(1, 10): 0.5, (1, 20): 0.333333, (2, 10): 1.0}


def test_training_passages_cover_labels_outside_the_candidates(spark):
    cand = spark.createDataFrame([(1, 10, 0), (1, 20, 1), (1, 30, 2)], "query_id bigint, article_id bigint, rank int")
    labels = spark.createDataFrame([(1, 10), (1, 40), (1, 10)], "query_id bigint, article_id bigint")
    chunks = spark.createDataFrame([(a, c, f"text {a} {'key' if c else ''}") for a in (10, 20, 30, 40) for c in (0, 1)], "article_id bigint, chunk_id int, text string")
    queries = spark.createDataFrame([(1, "key")], "query_id bigint, query_text string")
    found = rerank.training_passages(cand, labels, chunks, queries)
    assert sorted((r.article_id, r.chunk_id) for r in found.collect()) == [(10, 1), (20, 1), (30, 1), (40, 1)]
    assert sorted(r.positive_id for r in rerank.training_groups(cand, labels, found, 2).collect()) == [10, 40]


def test_article_vectors_of_repeated_title_rows(spark):
    from siftwell.operators import dense

    rows = spark.createDataFrame([(0, 0, [3.0, 0.0]), (0, 0, [3.0, 0.0]), (0, 1, [0.0, 4.0])], "article_id bigint, chunk_id int, emb array<double>")
    (got,) = dense.article_vectors(rows, rows.where("chunk_id = 0").select("article_id", "emb")).collect()
    n = (5.0**2 + (4 / 3) ** 2) ** 0.5
    assert [round(v, 9) for v in got.vec] == [round(5.0 / n, 9), round(4 / 3 / n, 9)]
