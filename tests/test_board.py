"""Scores of all pairs by article rows against the joins, and what the registered queries make of them."""

import math
import re

import numpy as np
import pytest

from siftwell.operators import board, fusion, lexical, rank
from siftwell.plans import catalogue

ARTICLES = [(0, "Red fox", "the red fox runs; a red-brown fox"), (1, "", "dog and cat"), (2, "fox", ""), (3, "", ""), (4, "Cat", "cat cat cat dog fox"), (5, "other", "words only here"), (6, "Red fox", "the red fox runs; a red-brown fox")]
QUERIES = [(3, "red fox"), (7, "cat dog fox fox"), (9, "zzz"), (11, ""), (12, None)]
WEIGHTS = {"bm25": 0.6, "char": 0.4}


@pytest.fixture(scope="module")
def tables(spark):
    corpus = spark.createDataFrame(ARTICLES, "article_id bigint, title string, clean_text string").repartition(3)
    queries = spark.createDataFrame(QUERIES, "query_id bigint, query_text string")
    return corpus, queries, {"bm25": lexical.bm25_scores(corpus, queries), "char": lexical.chargram_scores(corpus, queries)}


@pytest.fixture(scope="module")
def made(tables):
    return board.build(*tables[:2]).kept()


def same(got, want, *keys):
    a, b = ({tuple(r[k] for k in keys): tuple(v for c, v in sorted(r.asDict().items()) if c not in keys) for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and a
    for k, v in a.items():
        assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(v, b[k])), (k, v, b[k])


PAIR = ("query_id", "article_id")


def test_scores_equal_the_joins(tables, made):
    for s in ("bm25", "char"):
        same(made.long(s), tables[2][s], *PAIR)


def test_fusion_equals_the_grouped_forms(tables, made):
    src, n, norms = tables[2], len(ARTICLES), made.norms()
    same(made.weighted(WEIGHTS, norms), fusion.weighted_sum(src, WEIGHTS, n), *PAIR)
    same(made.features(), fusion.features(src, n), *PAIR)
    same(made.tagged(norms, "norm"), fusion.normalised(src, n).drop("score"), *PAIR, "source")
    for k in (1, 2, 30):
        same(made.top(k, WEIGHTS, norms), rank.top_k(fusion.weighted_sum(src, WEIGHTS, n), k), *PAIR)
        same(made.top(k, {"bm25": 1.0}), rank.top_k(src["bm25"], k), *PAIR)


def test_ensembles_equal_the_grouped_forms(tables, made):
    from pyspark.sql import functions as F

    models = fusion.tag(tables[2]).withColumn("fold", F.when(F.col("source") == "bm25", 0).otherwise(1))
    same(made.mean_zscore(), fusion.ensemble(models, "z"), *PAIR)
    same(made.mean_reciprocal_rank(), fusion.ensemble(models, "rr"), *PAIR)
    same(made.single(lambda s: board.listed_mean(s, s)), fusion.ensemble(models), *PAIR)
    same(made.subsets(), fusion.ensemble_subsets(models, 2), "subset", *PAIR)


def test_repeated_ids_take_the_joins(spark, tables):
    corpus, queries, _ = tables
    assert board.build(corpus.union(corpus.where("article_id = 1")), queries) is None
    assert board.build(corpus, queries.union(queries.where("query_id = 3"))) is None


@pytest.mark.parametrize("name", ["char_tfidf_scores", "minmax_scores", "fusion_features", "candidates", "ensemble_z"])
def test_repeated_ids_equal_the_sql(spark, name, tmp_path):
    """Rows of one id, copies and other texts, count together and leave no joins of postings."""
    import shutil

    import duckdb

    con, sf = duckdb.connect(), tmp_path / "sf"
    shutil.copytree("/root/testdata/sf0.001", sf)
    docs = "read_parquet('/root/testdata/sf0.001/documents.parquet')"
    again = f"SELECT * FROM {docs} WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id - 1, text, lang, source, n_chars FROM {docs} WHERE doc_id % 5 = 4"
    con.execute(f"CREATE TABLE documents AS SELECT * FROM {docs} UNION ALL {again}")
    (sf / "documents.parquet").chmod(0o644)
    sf.chmod(0o755)
    con.execute(f"COPY documents TO '{sf}/documents.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    df = catalogue.QUERIES[name](spark, str(sf))
    assert not re.search(r"hashpartitioning\(gram", df._jdf.queryExecution().executedPlan().toString())
    cur = con.execute(catalogue.ORACLES[name])
    cols = [d[0] for d in cur.description]
    key = [c for c in ("query_id", "article_id", "source") if c in cols]
    want = {tuple(r[cols.index(c)] for c in key): r for r in cur.fetchall()}
    got = {tuple(r[c] for c in key): tuple(r[c] for c in cols) for r in df.collect()}
    assert got.keys() == want.keys() and got
    for k, row in got.items():
        assert all(math.isclose(a, b, abs_tol=2e-6) if isinstance(a, float) else a == b for a, b in zip(row, want[k])), (k, row, want[k])


def test_places_find_keys_that_share_slots():
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    found = board.Places(keys).find(np.concatenate([keys[::-1], keys + 1]))
    assert (found[:5000] == np.arange(5000)[::-1]).all() and (found[5000:] == -1).all()
    assert (board.Places(keys[:0]).find(keys) == -1).all()


@pytest.mark.parametrize("name", ["fusion_features", "minmax_scores", "ensemble_mean", "ensemble_z", "ensemble_rr", "ensemble_subsets", "candidates", "aligned_sources", "char_tfidf_scores"])
def test_no_exchange_holds_a_row_a_pair(spark, name, tmp_path):
    """Disk at size: pairs are neither grouped nor joined through an exchange."""
    seen = []
    plain = type(spark.range(1)).checkpoint

    def note(df, *a):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, *a)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(spark.range(1)), "checkpoint", note)
        df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    for plan in (*seen, df._jdf.queryExecution().executedPlan().toString()):
        assert not re.search(r"hashpartitioning\((source#\d+, query_id|gram|query_id#\d+L?, article_id)", plan)


def test_gram_table_counts_inside_the_rows(spark, tables):
    from pyspark.sql import functions as F

    corpus, parts = tables[0].union(spark.createDataFrame([(8, "naïve 𝒳y", "a  ß x")], "article_id bigint, title string, clean_text string")), [("clean_text", 1.0), ("title", 2.0)]
    want = lambda c: lexical.gram_counts(c, parts, ["article_id"]).groupBy("gram").agg(F.count("*").alias("df"), F.sum("cnt").alias("cnt"))
    made = lexical.gram_table(corpus, parts, "article_id")
    same(made, want(corpus), "gram")
    assert "article_id" not in str(made._jdf.queryExecution().optimizedPlan().toString()).split("MapInArrow")[0]
    twice = corpus.union(corpus.where("article_id = 4"))
    same(lexical.gram_table(twice, parts, "article_id"), want(twice), "gram")


def test_out_of_fold_scores_replace_without_a_join_of_pairs(spark, tables, made):
    src, n, norms = tables[2], len(ARTICLES), made.norms()
    folds = spark.createDataFrame([(7,), (9,), (11,)], "query_id bigint")
    fused = fusion.weighted_sum(src, WEIGHTS, n).join(folds, "query_id", "left_semi")
    same(made.replaced("bm25", np.array([7, 9, 11]), WEIGHTS, norms), fusion.replace_out_of_fold(src["bm25"], fused, folds), *PAIR)
    same(made.replaced("bm25", np.array([], np.int64), WEIGHTS, norms), src["bm25"], *PAIR)


def test_oof_replace_shuffles_no_pair(spark):
    df = catalogue.QUERIES["oof_replace"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search(r"Exchange|Join", plan), plan
