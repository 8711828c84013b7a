"""The pipeline stage by stage, and the registered queries against SQL."""

import pytest

import corpus_pipeline
from siftwell.llm import queries as Q
from siftwell.llm import line_crf, simhash
from siftwell.llm.quality_rules import LineRules, judge

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        at[name] = (docs, spark.read.parquet(str(tmp_path / str(k))))
        docs = at[name][1]
        assert k == 4 or docs.columns == columns
    before, after = at["quality rules"]
    want = {r.doc_id: v[8] for r in before.collect() if (v := judge(r.text, LineRules()))[6]}
    assert {r.doc_id: r.text for r in after.collect()} == want
    before, after = at["quality classifier"]
    model = line_crf.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.prior is None
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if model.scores([r.text])[0] >= 0.3)
    before, after = at["near-duplicates"]
    ids = {r.doc_id for r in after.collect()}
    groups = {r.doc_id: r.component_id for r in simhash.near_groups(before).collect()}
    assert ids == set(groups.values())
    before, after = at["source mixing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    before, after = at["packing"]
    assert sorted(r.doc_id for r in after.where("piece = 0").collect()) == sorted(r.doc_id for r in before.collect())
    assert corpus_pipeline.run(spark, SF).count() == after.count()


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    got = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = con.execute(Q.ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = sorted(tuple(str(dict(zip(cols, r))[c]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(cols) == sorted(df.columns) and got == want
