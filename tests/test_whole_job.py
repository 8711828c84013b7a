"""Registered queries do the whole job: all chunks, whole texts, production settings."""

import inspect

import pytest

from siftwell.operators import graph, tuning
from siftwell.plans import catalogue


@pytest.fixture
def lab(spark, monkeypatch):
    """A lab of given articles and queries, every article a candidate, that the registered queries get."""

    def build(articles, queries):
        made = catalogue.Lab(spark, "")
        pairs = [(q, a, r) for q, _ in queries for r, (a, _) in enumerate(articles)]
        vars(made).update(
            corpus=spark.createDataFrame([(a, "", t) for a, t in articles], "article_id bigint, title string, clean_text string"),
            queries=spark.createDataFrame(queries, "query_id bigint, query_text string"),
            candidates=spark.createDataFrame(pairs, "query_id bigint, article_id bigint, rank int"),
            labels=spark.createDataFrame([(q, q) for q, _ in queries], "query_id bigint, article_id bigint"),
            splits=spark.createDataFrame([(q, q % 2) for q, _ in queries], "query_id bigint, fold int"),
        )
        monkeypatch.setattr(catalogue, "Lab", lambda *_: made)
        return made

    return build


def filler(n):
    return " ".join(["filler"] * n)


def test_rerank_lexical_sees_matches_beyond_the_first_chunk(spark, lab):
    lab([(0, f"{filler(900)} alpha beta"), (1, f"alpha {filler(900)}")], [(0, "alpha beta")])
    got = {r.article_id: r.score for r in catalogue.QUERIES["rerank_lexical"](spark, "").collect()}
    assert got == {0: 1.0, 1: 0.5}


def test_fold_models_see_matches_beyond_the_first_chunk(spark, lab, monkeypatch):
    n = 8
    lab([(i, f"{filler(900)} word{i} tail{i}") for i in range(n)], [(i, f"word{i} tail{i}") for i in range(n)])
    fitted, plain = [], tuning.group_rows
    monkeypatch.setattr(tuning, "group_rows", lambda *a: fitted.append(plain(*a)) or fitted[0])
    rows = catalogue.QUERIES["fold_model_scores"](spark, "").collect()
    assert len(rows) == 2 * n * n
    own = [r.score for r in rows if r.query_id == r.article_id]
    assert min(own) > max(r.score for r in rows if r.query_id != r.article_id)
    assert {(r.label, r.overlap) for r in fitted[0].collect()} == {(1, 1.0), (0, 0.0)}


def test_fold_models_without_negatives_are_the_plain_scorer(spark, lab):
    """Every candidate is relevant, so no query gives a training group."""
    made = lab([(i, f"{filler(900)} word{i} tail") for i in range(4)], [(i, f"word{i} tail") for i in range(4)])
    vars(made)["labels"] = made.candidates.select("query_id", "article_id")
    with pytest.warns(UserWarning, match="no training groups"):
        rows = catalogue.QUERIES["fold_model_scores"](spark, "").collect()
    assert sorted((r.fold, r.query_id, r.article_id, r.score) for r in rows) == [(f, q, a, 1.0 if q == a else 0.5) for f in (0, 1) for q in range(4) for a in range(4)]


def test_a_fold_without_training_groups_leaves_the_others_fitted(spark, lab):
    n = 8
    made = lab([(i, f"{filler(900)} word{i} tail{i}") for i in range(n)], [(i, f"word{i} tail{i}") for i in range(n)])
    plain = made.labels
    odd = made.candidates.where("query_id % 2 = 1").select("query_id", "article_id")
    vars(made)["labels"] = plain.where("query_id % 2 = 0").union(odd)  # fold 1 gives no group, so fold 0 has none to learn from
    with pytest.warns(UserWarning, match="fold 0 has no training groups"):
        rows = catalogue.QUERIES["fold_model_scores"](spark, "").collect()
    assert len(rows) == 2 * n * n
    assert {r.score for r in rows if r.fold == 0} == {0.0, 1.0} and not {0.0, 1.0} & {r.score for r in rows if r.fold == 1}


def test_chunks_cover_whole_texts(spark, lab):
    lab([(0, f"{filler(12_999)} last"), (1, "short")], [(0, "last")])
    texts = sorted((r.article_id, r.chunk_id, r.text.split()[-1], len(r.text.split())) for r in catalogue.QUERIES["chunks"](spark, "").collect())
    assert texts[42:] == [(0, 42, "last", 400), (1, 0, "short", 1)]
    assert {r.article_id: r.n for r in catalogue.QUERIES["chunk_counts"](spark, "").collect()} == {0: 43, 1: 1}
    assert {r.article_id: r.score for r in catalogue.QUERIES["rerank_multichunk"](spark, "").collect()} == {0: 1.0, 1: 0.0}


def test_fits_and_resampling_take_production_settings(spark, lab, monkeypatch):
    """Each query's operator is called with the settings of the staged run."""
    seen = {}

    def catch(where, name, *params):
        plain = getattr(where, name)

        def run(*a, **k):
            bound = inspect.signature(plain).bind(*a, **k)
            bound.apply_defaults()
            seen.update({p: bound.arguments[p] for p in params})
            raise Caught

        monkeypatch.setattr(where, name, run)

    class Caught(Exception):
        pass

    made = lab([(0, "alpha"), (1, "beta")], [(0, "alpha"), (1, "beta")])
    vars(made).update(n=2, sources={}, per_query=None)
    monkeypatch.setattr(catalogue, "_head_rows", lambda x: spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 0.0, 0.0)], "query_id int, article_id int, label int, fusion_norm double, fusion_rr double, rerank_norm double, rerank_rr double"))
    catch(catalogue.fusion, "out_of_fold_weights", "n_samples")
    catch(catalogue.tuning, "fold_scores", "n_negatives")
    catch(catalogue.ltr, "ListwiseNetwork", "hidden", "epochs", "rate", "decay")
    catch(catalogue.stats, "bootstrap_table", "resamples")
    for name in ("oof_fusion", "fold_model_scores", "mlp_fit", "bootstrap_distributed"):
        with pytest.raises(Caught):
            catalogue.QUERIES[name](spark, "")
    assert seen == {"n_samples": 500, "n_negatives": 7, "hidden": [16], "epochs": 300, "rate": 0.01, "decay": 0.03, "resamples": 10_000}


def test_distances_reach_the_end_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 0), (7, 7)], "src bigint, dst bigint")
    got = graph.distances(edges, spark.createDataFrame([(0,)], "node bigint")).collect()
    assert sorted((r.node, r.hops) for r in got) == [(i, i) for i in range(41)]
