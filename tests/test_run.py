"""The staged run on a small fixture, end to end, plus sources, sinks and streaming."""

import json

import pytest

from siftwell.operators import lexical, rank
from siftwell.plans import config as C
from siftwell.plans.stages import Run, compare, sweep
from siftwell.sources import sinks, tables
from siftwell.streaming.search import search_stream

TOPICS = ["garden roses watering", "bicycle chain repair", "coffee grinder cleaning", "piano tuning lesson", "winter tyre change", "bread oven baking", "camera lens filter", "mountain trail map", "fish tank heater", "chess opening theory", "paint brush drying", "sailing knot rope"]


@pytest.fixture(scope="module")
def mini(spark):
    articles = [(100 + i, t.title(), f"<p>All about {t}. <strong>{t}</strong> explained</p><script>x()</script>" + ('<a href="/articles/101">more</a>' if i == 3 else "")) for i, t in enumerate(TOPICS)]
    labelled = [(i, f"question on {t.replace('e', 'e', 1)}", str(100 + i) if i else "100 101") for i, t in enumerate(TOPICS[:10])]
    queries = [(1001 + i, f"help with {TOPICS[i]}") for i in range(5)]
    return tuple(spark.createDataFrame(rows, s) for rows, s in ((articles, tables.ARTICLES), (labelled, tables.LABELLED), (queries, tables.QUERIES)))


OVERRIDES = ["retrievers.char.min_df=1", "fusion.samples=4", "evaluation.resamples=200", "evaluation.recall_ks=[10]", "ranking.method=blend", "ranking.grid=5", "folds.n_splits=2"]


def test_staged_run(spark, mini, tmp_path):
    run = Run(spark, str(tmp_path / "r"), *mini, C.load(overrides=OVERRIDES))
    assert run.all().first().min_ids >= 1
    first = {r.query_id: r.answer for r in tables.read_answers(spark, run.path("answer")).collect()}
    assert first[1001].split()[0] == "100"
    report = {r.source: r for r in run.evaluate().collect()}
    assert report["bm25"].map > 0.5 and report["bm25"].low <= report["bm25"].map <= report["bm25"].high
    again = Run(spark, str(tmp_path / "r"), *mini, C.load(overrides=OVERRIDES))
    assert not again.preprocess() and not again.retrieve() and not again.fuse() and not again.blend()
    again.make_answer()
    assert {r.query_id: r.answer for r in tables.read_answers(spark, run.path("answer")).collect()} == first
    other = Run(spark, str(tmp_path / "r"), *mini, C.load(overrides=[*OVERRIDES, "seed=7"]))
    assert other.make_folds()
    rows = run.record().count()
    assert run.record().count() == rows
    assert compare([run.read("experiments")]).first().map >= 0
    run.holdout(budget=1)
    with pytest.raises(PermissionError):
        run.holdout(budget=1)


def test_sweep_prunes(spark, mini, tmp_path):
    base = [*OVERRIDES, "reranker.enabled=false"]
    table = sweep(spark, str(tmp_path / "s"), *mini, {"a": [*base, "fusion.method=rrf"], "b": base}, keep=1)
    assert table.count() == 2 and len(list((tmp_path / "s").iterdir())) == 1


@pytest.mark.parametrize("extra", [["ranking.method=lr", "ranking.graph.enabled=true"], ["ranking.method=auto", "ranking.mlp.epochs=20"]])
def test_learned_rankings(spark, mini, tmp_path, extra):
    over = [o for o in OVERRIDES if not o.startswith("ranking.method")] + ["retrievers.char.enabled=false", "retrievers.dense.enabled=true", "fusion.method=rrf", *extra]
    run = Run(spark, str(tmp_path / "r"), *mini, C.load(overrides=over))
    assert run.all().first().min_ids >= 1 and run.read("scores_blend").agg({"score": "min"}).first()[0] >= 1


def test_config_layers(tmp_path):
    f = tmp_path / "x.yaml"
    f.write_text("retrievers:\n  bm25:\n    k1: 2.0\n")
    c = C.load([str(f)], ["retrievers.bm25.b=0.5"])
    assert c["retrievers"]["bm25"] == {"enabled": True, "k1": 2.0, "b": 0.5, "title_weight": 2.0}
    assert C.section_hash(c, "retrievers") != C.section_hash(C.load(), "retrievers") and C.section_hash(c, "export") == C.section_hash(C.load(), "export")
    with pytest.raises(C.ConfigError):
        C.override(c, "novalue")


def test_index_round_trip_and_stream(spark, mini, tmp_path):
    from siftwell.operators import corpus

    base = corpus.corpus(mini[0])
    postings = lexical.bm25_postings(base)
    sinks.save_index(postings, str(tmp_path / "index"), {"k1": 1.5}, parts=2)
    back, meta = sinks.load_index(spark, str(tmp_path / "index"))
    assert meta == {"k1": 1.5}
    want = {(r.query_id, r.article_id) for r in rank.top_k(lexical.bm25_scores(base, mini[2]), 1).collect()}
    mini[2].write.parquet(str(tmp_path / "stream"))
    got = []
    q = search_stream(spark.readStream.schema(tables.QUERIES).parquet(str(tmp_path / "stream")), back, lambda b, i: got.extend((r.query_id, r.article_id) for r in b.collect()), str(tmp_path / "ck"), k=1)
    assert q.awaitTermination(120)
    assert set(got) == want


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "j.json")
    sinks.write_json(spark, p, {"b": 1, "a": "ё"})
    assert sinks.read_json(spark, p) == {"a": "ё", "b": 1} and json.loads(open(p, encoding="utf-8").read())
    s = spark.createDataFrame([(1, 2, 0.5, "a", "dev", 0), (1, 3, 0.5, "b", "dev", 1)], "query_id bigint, article_id bigint, score double, source string, split string, fold int")
    sinks.write_scores(s, str(tmp_path / "scores"))
    assert tables.read_scores(spark, str(tmp_path / "scores"), ["a"], "dev").count() == 1
    assert tables.missing_folds(spark, str(tmp_path / "none"), [0, 1]) == [0, 1]
    sinks.write_fold(s.where("fold = 0"), str(tmp_path / "f"))
    assert tables.missing_folds(spark, str(tmp_path / "f"), [0, 1]) == [1]


def test_feather(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"article_id": [1, 2], "title": ["a", None], "body": [None, "b"]})
    with pa.OSFile(str(tmp_path / "x.f"), "wb") as sink, pa.ipc.new_file(sink, t.schema) as w:
        w.write_table(t)
    got = tables.load_articles(tables.read_feather(spark, str(tmp_path / "x.f"), str(tmp_path / "x.parquet"))).orderBy("article_id").collect()
    assert [tuple(r) for r in got] == [(1, "a", ""), (2, "", "b")]
