"""Each catalogue query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from siftwell.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()
#: The cheap ones run here; all of them run in the driver's comparison.
NAMES = [n for n in ("qrels", "corpus_profile", "tokens_filtered", "chunks", "bm25_topk", "dense_topk", "best_chunk", "article_vectors", "splits", "ap_at_10", "funnel", "map_report", "head_tail", "co_label_edges", "link_components", "contract_violations", "variants_static", "page_links", "lr_schedule", "experiments_latest")]


def plain(v):
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else repr(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = duck.execute(catalogue.ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = sorted(tuple(plain(dict(zip(cols, r))[c]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(cols) and got == want


def test_article_vectors_keep_the_sign_of_small_components(spark, tmp_path):
    """Compared by representation, -0.0 is not 0.0."""
    import duckdb

    rows = [(i, [1.0, s * 1e-7, s * 0.25, s * 0.0, *[0.0] * 60]) for i, s in enumerate((1.0, -1.0, -1.0, 1.0, -1.0))]
    rows += [(5 + i, [1.0, -1e-7, -0.25, -0.0, *[0.0] * 60]) for i in range(5)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.article_id, plain(r.vec)) for r in catalogue.QUERIES["article_vectors"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted((a, plain(v)) for a, v in con.execute(catalogue.ORACLES["article_vectors"]).fetchall())
    assert got == want and "-0.0'" in dict(got)[1]


def test_entry_imports_without_the_optional_parts():
    import subprocess
    import sys
    import textwrap

    code = textwrap.dedent(
        """
        import sys
        class Hide:
            def find_spec(self, name, path=None, target=None):
                if name == "corpus_pipeline" or name.startswith("siftwell.llm"):
                    raise ModuleNotFoundError(name, name=name)
        sys.meta_path.insert(0, Hide())
        import __spark_entry__ as e
        assert "bm25_topk" in e.queries() and not [n for n in e.queries() if n.startswith("op") and n[2].isdigit()]
        """
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
