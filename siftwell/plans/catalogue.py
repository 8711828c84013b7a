"""Every operator as a query over the driver's tables, each with its SQL.

Roles: documents are articles (first line = title), benchmark passages are queries, documents that contain
a passage are its labels, embeddings are chunk vectors (five a article), pages are HTML articles,
conversations feed the placeholder operators.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import perturb
from siftwell.functions import text as T
from siftwell.functions.html import html_to_text
from siftwell.operators import answers, board, contracts, corpus, dense, diagnostics, fusion, graph, lexical, ltr, metrics, rank, rerank, splits, stats, tuning
from siftwell.plans import sqltext as S
from siftwell.plans import stages
from siftwell.plans.config import DEFAULTS
from siftwell.sources import sinks, tables

WEIGHTS = {"bm25": 0.6, "char": 0.4}
DEEP = 51  # no registered measure looks further, save first_rank
GRID = [[1.0, 0.0], [0.0, 1.0], [0.5, 0.5], [0.6, 0.4], [0.8, 0.2], [0.3, 0.7]]
FUSION_HEAD = ltr.Logistic(("bm25_norm", "bm25_rr", "char_norm", "char_rr"), (1.5, 0.5, 1.0, 0.25), -1.0, (0.1, 0.05, 0.1, 0.05), (0.5, 0.25, 0.5, 0.25))
BLEND_HEAD = ltr.Logistic(("fusion_norm", "fusion_rr", "rerank_norm", "rerank_rr"), (1.0, 0.5, 2.0, 0.5), -0.5, (0.5, 0.1, 0.5, 0.1), (0.25, 0.2, 0.25, 0.2))


class Lab:
    """The roles and shared intermediate tables of one data folder, each declared once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return tables.driver_table(self.spark, self.dir, name)

    @cached_property
    def corpus(self) -> DataFrame:
        return corpus.from_documents(tables.spread(self.table("documents").select("doc_id", "text")))

    @cached_property
    def n(self) -> int:
        return self.table("documents").count()

    @cached_property
    def queries(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))

    def found_labels(self) -> DataFrame:
        return corpus.containment_labels(self.table("documents"), self.table("benchmark"))

    @cached_property
    def labels(self) -> DataFrame:
        return self.kept(self.found_labels())

    def kept(self, df: DataFrame) -> DataFrame:
        """A small table that is read several times, written once."""
        graph.ensure_checkpoints(self.spark)
        return df.checkpoint()

    @cached_property
    def bm25(self) -> DataFrame:
        return lexical.bm25_scores(self.corpus, self.queries)

    @cached_property
    def char(self) -> DataFrame:
        made = board.build(self.corpus, self.queries, ("char",), repeats=True)
        return lexical.chargram_scores(self.corpus, self.queries) if made is None else made.long("char")

    @cached_property
    def passing(self) -> board.Board | None:
        """Both sources' scores, for one reading."""
        return board.build(self.corpus, self.queries, repeats=True)

    @cached_property
    def board(self) -> board.Board | None:
        return self.passing and self.passing.kept()

    @cached_property
    def norms(self):
        return self.board.norms()

    @cached_property
    def sources(self) -> dict[str, DataFrame]:
        if self.board is None:
            return {"bm25": self.bm25, "char": lexical.chargram_scores(self.corpus, self.queries)}
        return {s: self.board.long(s) for s in self.board.sources}

    @cached_property
    def fused(self) -> DataFrame:
        return fusion.weighted_sum(self.sources, WEIGHTS, self.n) if self.board is None else self.board.weighted(WEIGHTS, self.norms)

    def fused_top(self, k: int) -> DataFrame:
        return rank.top_k(self.fused, k) if self.board is None else self.board.top(k, WEIGHTS, self.norms)

    def bm25_top(self, k: int) -> DataFrame:
        """Of the board, where the fused scores are asked for too."""
        return rank.top_k(self.bm25, k) if self.board is None else self.board.top(k, {"bm25": 1.0})

    @cached_property
    def candidates(self) -> DataFrame:
        return self.kept(self.fused_top(30))

    @cached_property
    def chunks(self) -> DataFrame:
        return corpus.chunk_table(self.corpus, most=None)

    def chunks_of(self, *pairs: DataFrame) -> DataFrame:
        """All chunks of the articles of the given tables; no other article is cut."""
        ids = reduce(DataFrame.union, [p.select("article_id") for p in pairs]).distinct()
        return corpus.chunk_table(self.corpus.join(rank.few(ids, rank.BROADCAST_GROUPS), "article_id", "left_semi"), most=None)

    @cached_property
    def passages(self) -> DataFrame:
        return self.candidates.select("query_id", "article_id").join(self.chunks_of(self.candidates), "article_id").select("query_id", "article_id", "chunk_id", F.col("text").alias("passage"))

    @cached_property
    def best(self) -> DataFrame:
        """Each candidate's best chunk for the query, of all its chunks."""
        return rerank.best_passages(self.candidates, self.chunks_of(self.candidates), self.queries)

    @cached_property
    def reranked(self) -> DataFrame:
        return self.kept(rerank.rerank(self.candidates, self.passages, self.queries))

    @cached_property
    def blend(self) -> DataFrame:
        return rerank.manual_blend(self.candidates.drop("rank"), self.reranked, 0.3)

    @cached_property
    def splits(self) -> DataFrame:
        return splits.hash_splits(splits.label_counts(self.queries, self.labels))

    @cached_property
    def chunk_vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.floor(F.col("vec_id") / 5).cast("bigint").alias("article_id"), (F.col("vec_id") % 5).alias("chunk_id"), F.col("embedding").alias("emb"))

    @cached_property
    def title_vectors(self) -> DataFrame:
        return self.chunk_vectors.where("chunk_id = 0").select("article_id", "emb")

    @cached_property
    def query_vectors(self) -> DataFrame:
        """The stated query set: rows whose id is divisible by 50, against all rows."""
        return self.table("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("emb"))

    @cached_property
    def page_links(self) -> DataFrame:
        found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="(/[^"]*)"'), F.lit(1))
        return self.table("pages").select("page_id", F.explode(F.array_distinct(found)).alias("target")).distinct()

    @cached_property
    def page_edges(self) -> DataFrame:
        return graph.shared_target_edges(self.page_links)

    @cached_property
    def page_graph(self) -> DataFrame:
        return self.page_edges.union(self.page_edges.select("dst", "src")).distinct()

    @cached_property
    def per_query(self) -> DataFrame:
        """Quality of each query's first ``DEEP`` articles; a relevant one further down counts as not found."""
        return metrics.per_query(rank.top_k(self.bm25, DEEP), self.labels, self.queries)

    @cached_property
    def per_query_fused(self) -> DataFrame:
        return metrics.per_query(self.fused_top(DEEP), self.labels, self.queries)

    @cached_property
    def per_query_both(self) -> tuple[DataFrame, DataFrame]:
        """Of BM25 and of the fused scores, from one board."""
        return self.kept(metrics.per_query(self.bm25_top(DEEP), self.labels, self.queries)), self.kept(self.per_query_fused)


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols or ("score",)})


def signed_r6(v: Column) -> Column:
    """Six decimals as SQL rounds them: a small negative number becomes -0.0, which Spark's round makes 0.0."""
    return F.signum(v) * F.round(F.abs(v), 6)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f: Callable[[Lab], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Lab(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


# ---- text ------------------------------------------------------------------------------------------

query("qrels", S.sql("SELECT * FROM labels_t", "labels_t"))(lambda x: x.found_labels())
query("corpus", S.sql("SELECT * FROM corpus", "corpus"))(lambda x: x.corpus)
query("corpus_profile", S.sql("SELECT count(*) AS n_articles, round(avg((len(clean_text) = 0)::INTEGER::DOUBLE), 6) AS empty_share, quantile_cont(len(clean_text), 0.5) AS median_chars, max(len(clean_text))::BIGINT AS max_chars FROM corpus", "corpus"))(lambda x: corpus.profile(x.corpus))
query("tokens_filtered", S.sql(f"SELECT article_id, array_to_string({S.tok('clean_text')}, ' ') AS tokens FROM corpus", "corpus"))(lambda x: x.corpus.select("article_id", F.array_join(T.tokens("clean_text"), " ").alias("tokens")))
query("word_counts", f"SELECT w AS word, count(*) AS n FROM (SELECT unnest({S.blank_words('text')}) AS w FROM documents) GROUP BY w")(
    lambda x: x.table("documents").select(F.explode(T.blank_words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
)
query("common_words", f"SELECT w AS word, count(*) AS n FROM (SELECT unnest({S.blank_words('text')}) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 50")(
    lambda x: x.table("documents").select(F.explode(T.blank_words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)
)
query("whitespace_clean", f"SELECT page_id, {S.fold_blanks('html')} AS clean FROM pages")(lambda x: x.table("pages").select("page_id", T.collapse_blanks("html").alias("clean")))
query(
    "html_text_regex",
    "SELECT page_id, " + S.fold_blanks("replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?is)<svg\\b.*?</svg>', ' ', 'g'), '(?is)<button\\b.*?</button>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')") + " AS text FROM pages",
)(lambda x: x.table("pages").select("page_id", T.html_to_text_pattern("html").alias("text")))
query("html_text")(lambda x: x.table("pages").select("page_id", html_to_text("html").alias("text")))
query("page_links", S.sql("SELECT page_id, target FROM plinks", "plinks"))(lambda x: x.page_links)
query("article_links", "SELECT page_id, list_transform(list_distinct(regexp_extract_all(url, '/([0-9]+)', 1)), lambda v: v::BIGINT) AS ids FROM pages")(lambda x: x.table("pages").select("page_id", T.article_links("url", "/([0-9]+)").alias("ids")))
query(
    "placeholder_sub",
    "SELECT conv_id, turn, replace(replace(replace(replace(replace(t, '<MONEY>', ' деньги '), '<DATE>', ' дата '), '<PHONE>', ' телефон '), '<URL>', ' ссылка '), '<ID>', ' ') AS text FROM (SELECT conv_id, turn, regexp_replace(text, '[0-9]+', '<MONEY>', 'g') || ' <ID>' AS t FROM conversations)",
)(lambda x: x.table("conversations").select("conv_id", "turn", T.substitute_placeholders(F.concat(F.regexp_replace("text", "[0-9]+", "<MONEY>"), F.lit(" <ID>"))).alias("text")))
query("chunks", S.sql("SELECT article_id, chunk_id::INTEGER AS chunk_id, text FROM chunk_t", "chunk_t"))(lambda x: x.chunks)
query("chunk_counts", S.sql("SELECT article_id, count(*) AS n FROM chunk_t GROUP BY article_id", "chunk_t"))(lambda x: x.chunks.groupBy("article_id").agg(F.count("*").alias("n")))
query(
    "char_ngrams", S.sql("SELECT gram, count(*) AS df, round(sum(cnt), 6) AS cnt FROM cg GROUP BY gram", "cg")
)(lambda x: r6(lexical.gram_table(x.corpus, [("clean_text", 1.0), ("title", 2.0)], "article_id"), "cnt"))
query(
    "query_flags",
    S.sql("SELECT query_id, n AS n_words, len(query_text)::BIGINT AS n_chars, regexp_matches(query_text, '<(MONEY|DATE|PHONE|URL|ID)>')::INTEGER AS has_placeholder, CASE WHEN n <= 7 THEN '1-7' WHEN n <= 12 THEN '8-12' WHEN n <= 20 THEN '13-20' ELSE '21+' END AS length_bin FROM (SELECT *, len(regexp_extract_all(query_text, '[\\p{L}\\p{M}\\p{N}_]+'))::BIGINT AS n FROM queries)", "queries"),
)(lambda x: diagnostics.query_flags(x.queries))
query("stub_embedding")(lambda x: x.table("documents").select("doc_id", F.transform(T.hashing_embedding("text"), lambda v: F.round(v, 6)).alias("emb")))

# ---- retrieval -------------------------------------------------------------------------------------

query("bm25_postings", S.sql("SELECT term, article_id, round(weight, 6) AS weight FROM post", "post"))(lambda x: r6(lexical.bm25_postings(x.corpus), "weight"))
query("bm25_scores", S.sql("SELECT query_id, article_id, round(score, 6) AS score FROM bm25", "bm25"))(lambda x: r6(x.bm25))
query("bm25_topk", S.sql("SELECT query_id, article_id, round(score, 6) AS score, rank FROM bm25_r WHERE rank < 10", "bm25_r"))(lambda x: r6(rank.top_k(x.bm25, 10)))
query("bm25_rankings", S.sql("SELECT query_id, list(article_id ORDER BY rank) AS article_ids FROM bm25_top GROUP BY query_id", "bm25_top"))(lambda x: rank.rankings(rank.top_k(x.bm25, 10)))
query("retrieval_frame", S.sql("SELECT query_id, article_id, round(score, 6) AS score, rank, 'bm25' AS source FROM bm25_r WHERE rank < 20", "bm25_r"))(lambda x: r6(rank.retrieval_frame(x.bm25, 20, "bm25")))
query("char_tfidf_scores", S.sql("SELECT query_id, article_id, round(score, 6) AS score FROM chars", "chars"))(lambda x: r6(x.char))
query("char_tfidf_topk", S.sql("SELECT query_id, article_id, round(score, 6) AS score, rank FROM char_r WHERE rank < 10", "char_r"))(lambda x: r6(rank.top_k(x.char, 10)))
query("dense_scores", S.sql("SELECT query_id, article_id, round(score, 6) AS score FROM dense", "dense"))(lambda x: r6(dense.dense_scores(x.query_vectors, x.chunk_vectors, x.title_vectors)))
query("dense_topk", S.sql("SELECT query_id, article_id, round(score, 6) AS score, rank FROM dense_r WHERE rank < 10", "dense_r"))(lambda x: r6(rank.top_k(dense.dense_scores(x.query_vectors, x.chunk_vectors, x.title_vectors), 10)))
_TOP_CHUNKS = "SELECT query_id, article_id, (r - 1)::INTEGER AS chunk_rank, chunk_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id, article_id ORDER BY round(sim, 6) DESC, chunk_id) AS r FROM sims SEMI JOIN (SELECT * FROM dense_r WHERE rank < 10) USING (query_id, article_id)) WHERE r <= "
for _name, _m in (("top_chunks", 3), ("best_chunk", 1)):
    query(_name, S.sql(f"{_TOP_CHUNKS}{_m}", "sims", "dense_r"))(lambda x, m=_m: r6(dense.top_chunks(rank.top_k(dense.dense_scores(x.query_vectors, x.chunk_vectors, x.title_vectors), 10), x.query_vectors, x.chunk_vectors, m), "sim"))
query("article_vectors", S.sql("SELECT article_id, list_transform(vec, lambda v: round(v, 6)) AS vec FROM avec", "avec"))(lambda x: dense.article_vectors(x.chunk_vectors, x.title_vectors).select("article_id", F.transform("vec", signed_r6).alias("vec")))
query(
    "article_sim_topk",
    S.sql("SELECT query_id, article_id, round(score, 6) AS score, rank FROM (" + S.ranked("s") + ") WHERE rank < 5", "emb_q", "avec", s="SELECT query_id, article_id, list_dot_product(emb, vec) AS score FROM emb_q, avec"),
)(lambda x: r6(rank.top_k(dense.similarities(x.query_vectors, dense.article_vectors(x.chunk_vectors, x.title_vectors).withColumnRenamed("vec", "emb"), ["article_id"]).withColumnRenamed("sim", "score"), 5)))

# ---- fusion ----------------------------------------------------------------------------------------

query("minmax_scores", S.sql("SELECT query_id, article_id, source, round(norm, 6) AS norm FROM norm_t", "norm_t"))(lambda x: r6(fusion.normalised(x.sources, x.n).drop("score") if x.board is None else x.board.tagged(x.norms, "norm"), "norm"))
query("fusion_weighted", S.sql("SELECT query_id, article_id, round(score, 6) AS score, rank FROM fused_r WHERE rank < 30", "fused_r"))(lambda x: r6(x.candidates))
query("candidates", S.sql("SELECT query_id, list(article_id ORDER BY rank) AS article_ids FROM cand GROUP BY query_id", "cand"))(lambda x: tables.candidate_lists(x.candidates))
query("fusion_rrf", S.sql("SELECT query_id, article_id, round(score, 6) AS score, rank FROM (" + S.ranked("rrf") + ") WHERE rank < 30", "rrf"))(lambda x: r6(rank.top_k(fusion.reciprocal_rank_fusion(x.sources), 30)))
query("fusion_features", S.sql("SELECT query_id, article_id, round(bm25_norm, 6) AS bm25_norm, round(bm25_rr, 6) AS bm25_rr, round(char_norm, 6) AS char_norm, round(char_rr, 6) AS char_rr FROM feat", "feat"))(
    lambda x: r6(features(x), "bm25_norm", "bm25_rr", "char_norm", "char_rr")
)
_SIG = lambda head: "1 / (1 + exp(-(" + f"{head.bias}e0" + "".join(f" + {c}e0 * (({n} - {m}e0) / {s}e0)" for n, c, m, s in zip(head.names, head.coef, head.mean, head.scale)) + ")))"
query("fusion_lr_predict", S.sql(f"SELECT query_id, article_id, round({_SIG(FUSION_HEAD)}, 6) AS score FROM feat", "feat"))(lambda x: r6(ltr.predict(features(x), FUSION_HEAD)))
_grid = ", ".join(f"({i}, {a}e0, {b}e0)" for i, (a, b) in enumerate(GRID))
_scored = f"SELECT wid, query_id, article_id, w1 * bm25_norm + w2 * char_norm AS score FROM feat SEMI JOIN labels_t USING (query_id), (VALUES {_grid}) g(wid, w1, w2)"
_asked = f"SELECT DISTINCT wid, query_id FROM labels_t, (VALUES {_grid}) g(wid, w1, w2)"
query(
    "fusion_weight_grid",
    S.sql("SELECT wid, round(avg(ap), 6) AS map, round(avg(recall_30), 6) AS recall FROM pqw GROUP BY wid", "feat", "labels_t", scored=_scored, asked=_asked, topw="SELECT * FROM (" + S.ranked("scored", "wid, query_id") + ") WHERE rank < 30", pqw=S.per_query("topw", "asked", 10, (30,), "wid, query_id")),
)(lambda x: weight_grid(x))
query(
    "oof_replace",
    S.sql("SELECT query_id, article_id, round(score, 6) AS score FROM (SELECT * FROM bm25 ANTI JOIN dev USING (query_id) UNION ALL SELECT * FROM fused SEMI JOIN dev USING (query_id))", "bm25", "fused", "splits", dev="SELECT query_id FROM splits WHERE fold IS NOT NULL"),
)(lambda x: r6(out_of_fold(x)))


def out_of_fold(x: Lab) -> DataFrame:
    folds = x.kept(x.splits.where("fold is not null").select("query_id"))
    if x.board is None:
        return fusion.replace_out_of_fold(x.sources["bm25"], x.fused.join(rank.few(folds, rank.BROADCAST_GROUPS), "query_id", "left_semi"), folds)
    return x.board.replaced("bm25", np.array([r.query_id for r in folds.collect()], np.int64), WEIGHTS, x.norms)  # queries of the board at most


def features(x: Lab) -> DataFrame:
    return fusion.features(x.sources, x.n) if x.passing is None else x.passing.features()


def weight_grid(x: Lab) -> DataFrame:
    weights = fusion.weight_table(x.spark, list(WEIGHTS), np.array(GRID))
    if x.board is None:
        return fusion.evaluate_weights(x.sources, x.labels, x.queries.select("query_id"), weights, n_articles=x.n)
    labelled = [r.query_id for r in x.labels.select("query_id").distinct().collect()]  # queries of the board at most
    best = x.board.best(30, [dict(zip(WEIGHTS, w)) for w in GRID], x.norms, np.array(labelled, np.int64))
    return fusion.weight_quality(rank.top_k(best, 30, by=("wid", "query_id")), x.labels, x.queries.select("query_id"), weights)


query("oof_fusion")(lambda x: r6(rank.top_k(fusion.out_of_fold_weights(x.sources, x.labels, x.splits.where("fold is not null"), n_samples=DEFAULTS["fusion"]["samples"], n_articles=x.n)[0], 10)))

# ---- re-ranking ------------------------------------------------------------------------------------

query("best_passages", S.sql("SELECT query_id, article_id, chunk_id::INTEGER AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, article_id ORDER BY round(s, 6) DESC, chunk_id) AS r FROM pair_chunks) WHERE r <= 2", "pair_chunks"))(lambda x: rerank.best_passages(x.candidates, x.chunks_of(x.candidates), x.queries, 2).drop("passage"))
query("rerank_multichunk", S.sql("SELECT query_id, article_id, round(score, 6) AS score FROM rer", "rer"))(lambda x: r6(x.reranked))
query(
    "rerank_lexical",
    S.sql("SELECT query_id, article_id, round(max(s), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, article_id ORDER BY chunk_id) AS r FROM pair_chunks) WHERE r = 1 GROUP BY ALL", "pair_chunks"),
)(lambda x: r6(rerank.rerank(x.candidates, x.best, x.queries)))
query("blend_features", S.sql("SELECT query_id, article_id, round(fusion_norm, 6) AS fusion_norm, round(fusion_rr, 6) AS fusion_rr, round(rerank_norm, 6) AS rerank_norm, round(rerank_rr, 6) AS rerank_rr FROM blend_f", "blend_f"))(
    lambda x: r6(rerank.blend_features(x.candidates.drop("rank"), x.reranked), "fusion_norm", "fusion_rr", "rerank_norm", "rerank_rr")
)
query("blend_manual", S.sql("SELECT query_id, article_id, round(score, 6) AS score, rank FROM blend_r WHERE rank < 10", "blend_r"))(lambda x: r6(rank.top_k(x.blend, 10)))
query("blend_lr_predict", S.sql(f"SELECT query_id, article_id, round(1 + {_SIG(BLEND_HEAD)}, 6) AS score FROM blend_f", "blend_f"))(lambda x: r6(ltr.predict_blend(rerank.blend_features(x.candidates.drop("rank"), x.reranked), BLEND_HEAD)))
query(
    "blend_weight_grid",
    S.sql("SELECT wid::INTEGER AS wid, round(wid / 10e0, 6) AS weight, round(avg(ap), 6) AS map FROM pqb GROUP BY wid", "blend_f", "labels_t",
          scored="SELECT wid, query_id, article_id, 1 + wid / 10e0 * fusion_norm + (1 - wid / 10e0) * rerank_norm AS score FROM blend_f SEMI JOIN labels_t USING (query_id), (SELECT unnest(range(11)) AS wid) g",
          asked="SELECT DISTINCT wid, query_id FROM labels_t, (SELECT unnest(range(11)) AS wid) g", topb="SELECT * FROM (" + S.ranked("scored", "wid, query_id") + ") WHERE rank < 10", pqb=S.per_query("topb", "asked", 10, (10,), "wid, query_id")),
)(lambda x: rerank.blend_search(x.candidates.drop("rank"), x.reranked, x.labels, x.queries, steps=11))
query("hard_negatives", S.sql("SELECT query_id, article_id, neg_rank::INTEGER AS neg_rank FROM negs WHERE neg_rank < 7", "negs"))(lambda x: rerank.hard_negatives(x.candidates, x.labels, 7))
query(
    "training_groups",
    S.sql("SELECT query_id, article_id AS positive_id, ids AS negative_ids FROM (SELECT query_id, article_id FROM labels_t SEMI JOIN cand USING (query_id, article_id)) JOIN (SELECT query_id, list(article_id ORDER BY neg_rank) AS ids FROM negs WHERE neg_rank < 7 GROUP BY query_id HAVING count(*) = 7) USING (query_id)", "negs", "cand", "labels_t"),
)(lambda x: rerank.training_groups(x.candidates, x.labels, x.passages))
query("lr_schedule", "SELECT s AS step, round(CASE WHEN s < 10 THEN (s + 1) / 10e0 ELSE 0.5e0 * (1 + cos(pi() * (s - 10) / 90e0)) END, 6) AS factor FROM (SELECT unnest(range(100)) AS s)")(
    lambda x: x.spark.range(100).select(F.col("id").alias("step"), F.round(rerank.schedule(F.col("id"), 100), 6).alias("factor"))
)

# ---- graphs ----------------------------------------------------------------------------------------

query("co_label_edges", S.sql("SELECT * FROM co", "co"))(lambda x: graph.co_labels(x.labels))
query("gt_freq", S.sql("SELECT * FROM freq", "freq"))(lambda x: graph.label_frequency(x.labels))
query("page_edges", S.sql("SELECT src, dst FROM pedges", "pedges"))(lambda x: x.page_edges)
for _name, _pre in (("graph_features_loo", "g_"), ("graph_features", "t_")):
    query(_name, S.sql(f"SELECT * FROM {_pre}feats", f"{_pre}feats"))(
        lambda x, p=_pre: r6(
            graph.graph_features(x.reranked, x.labels if p == "g_" else x.labels.join(splits_train(x), "query_id", "left_semi"), x.page_graph, dense.article_vectors(x.chunk_vectors, x.title_vectors)),
            "co_top_p", "link_top", "sim_top", "gt_freq", "co_x_margin",
        )
    )


def splits_train(x: Lab) -> DataFrame:
    return splits.train_ids(x.splits, 0)


def _closure(edges: str) -> str:
    return f"""WITH RECURSIVE {edges}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r(node, root) AS (SELECT src, src FROM b UNION SELECT b.dst, r.root FROM r JOIN b ON b.src = r.node)
SELECT node, min(root) AS root FROM r GROUP BY node"""


query("link_components", _closure("pl AS (" + S.CTE["plinks"][1] + "), e AS (SELECT DISTINCT m.src, page_id AS dst FROM pl JOIN (SELECT target, min(page_id) AS src FROM pl GROUP BY target) m USING (target) WHERE m.src < page_id)"))(lambda x: graph.components(x.page_edges))
query("co_label_components", _closure("lt AS (" + S.CTE["labels_t"][1] + "), e AS (SELECT DISTINCT x.article_id AS src, y.article_id AS dst FROM lt x JOIN lt y USING (query_id) WHERE x.article_id <> y.article_id)"))(
    lambda x: graph.components(graph.co_labels(x.labels).select(F.col("a").alias("src"), F.col("b").alias("dst")))
)
query(
    "link_distances",
    "WITH RECURSIVE pl AS (" + S.CTE["plinks"][1] + "), e0 AS (SELECT DISTINCT m.src, page_id AS dst FROM pl JOIN (SELECT target, min(page_id) AS src FROM pl GROUP BY target) m USING (target) WHERE m.src < page_id), r(node, hops) AS (SELECT min(src), 0 FROM e0 UNION SELECT e0.dst, hops + 1 FROM r JOIN e0 ON e0.src = r.node) SELECT node, min(hops)::INTEGER AS hops FROM r GROUP BY node",
)(lambda x: graph.distances(x.page_edges, x.page_edges.agg(F.min("src").alias("node"))))
query("degree_profile", S.sql("SELECT sum(coalesce(d, 0))::BIGINT AS edges, count(d) AS linked, count(*) FILTER (d IS NULL) AS isolated, coalesce(max(d), 0) AS max_degree FROM (SELECT page_id AS src FROM pages) LEFT JOIN (SELECT src, count(*) AS d FROM links2 GROUP BY src) USING (src)", "links2"))(
    lambda x: graph.degree_profile(x.page_graph, x.table("pages").select(F.col("page_id").alias("article_id")))
)
query(
    "paired_top3",
    S.sql("SELECT r.query_id, r.article_id, r.rank, coalesce(max((c.a IS NOT NULL)::INTEGER), 0) AS paired FROM bm25_top r LEFT JOIN bm25_top t ON t.query_id = r.query_id AND t.rank < 3 AND t.article_id <> r.article_id LEFT JOIN co c ON c.a = r.article_id AND c.b = t.article_id GROUP BY ALL", "bm25_top", "co"),
)(lambda x: graph.paired_with_top(rank.top_k(x.bm25, 10).drop("score"), graph.co_labels(x.labels)))
query("shared_edges", S.sql("SELECT c.* FROM co c SEMI JOIN near l ON l.a = c.a AND l.b = c.b WHERE c.a < c.b", "co", "bm25_top", near="SELECT DISTINCT x.article_id AS a, y.article_id AS b FROM bm25_top x JOIN bm25_top y USING (query_id) WHERE x.article_id <> y.article_id"))(
    lambda x: graph.shared_edges(graph.co_labels(x.labels), graph.co_labels(rank.top_k(x.bm25, 10)).select(F.col("a").alias("src"), F.col("b").alias("dst")))  # label pairs that are retrieved together
)
query("link_edges", S.sql("SELECT src, dst FROM known UNION SELECT dst, src FROM known", known="SELECT src, dst FROM (SELECT doc_id AS src, unnest([doc_id * 7 % 1009, doc_id // 2, 1000000 + doc_id]) AS dst FROM documents) l SEMI JOIN documents d ON d.doc_id = l.dst WHERE src <> dst"))(lambda x: graph.link_edges(_linked(x)))


def _linked(x: Lab) -> DataFrame:
    """Articles whose bodies link to others, known and unknown, some twice."""
    href = lambda to: F.concat(F.lit('<a href="/articles/'), to.cast("string"), F.lit('">x</a>'))
    i = F.col("doc_id")
    return x.table("documents").select(i.alias("article_id"), F.concat(href(i * 7 % 1009), href(F.floor(i / 2)), href(i + 1_000_000), href(i * 7 % 1009)).alias("body"))


# ---- splits, metrics, diagnostics ------------------------------------------------------------------

query("splits", S.sql("SELECT * FROM splits", "splits"))(lambda x: x.splits)
query("fold_sizes", S.sql("SELECT split, fold, count(*) AS n FROM splits GROUP BY ALL", "splits"))(lambda x: splits.fold_sizes(x.splits))
query("ap_at_10", S.sql("SELECT query_id, n_rel, round(ap, 6) AS ap FROM pq", "pq"))(lambda x: r6(x.per_query, "ap").select("query_id", "n_rel", "ap"))
query("recall_at_k", S.sql("SELECT query_id, round(recall_10, 6) AS recall_10, round(recall_20, 6) AS recall_20, round(recall_30, 6) AS recall_30 FROM p", "bm25_r", "queries", "labels_t", p=S.per_query("bm25_r", ks=(10, 20, 30))))(
    lambda x: r6(metrics.per_query(rank.top_k(x.bm25, 30), x.labels, x.queries, 10, (10, 20, 30)), "recall_10", "recall_20", "recall_30").select("query_id", "recall_10", "recall_20", "recall_30")
)
query("map_report", S.sql("SELECT count(*) AS n_queries, round(avg(ap), 6) AS map, round(avg(recall_10), 6) AS recall_10 FROM pq", "pq"))(lambda x: metrics.summary(x.per_query))
query("first_rank", S.sql("SELECT query_id, first_rank FROM pq", "pq"))(lambda x: metrics.per_query(rank.with_rank(x.bm25), x.labels, x.queries).select("query_id", "first_rank"))
query("stage_summary", S.sql("SELECT count(*) AS n, round(avg(ap), 6) AS map, round(avg((first_rank <= 10)::INTEGER::DOUBLE), 6) AS hit_10, round(avg(least(first_rank, 51)), 6) AS mean_first_rank FROM pq", "pq"))(lambda x: diagnostics.stage_summary(x.per_query))
query(
    "funnel",
    S.sql("SELECT CASE WHEN f = 0 THEN 'candidate_miss' WHEN h = 0 THEN 'ranking_miss' WHEN h < least(r, 10) THEN 'partial' ELSE 'perfect' END AS stage, count(*) AS n FROM (SELECT query_id, count(*) AS r, count(c.rank) AS f, count(*) FILTER (b.rank < 10) AS h FROM labels_t LEFT JOIN cand c USING (query_id, article_id) LEFT JOIN bm25_r b USING (query_id, article_id) GROUP BY query_id) GROUP BY stage", "labels_t", "cand", "bm25_r"),
)(lambda x: diagnostics.funnel(x.candidates, x.bm25_top(10), x.labels))
_flags = "SELECT query_id, CASE WHEN n <= 7 THEN '1-7' WHEN n <= 12 THEN '8-12' WHEN n <= 20 THEN '13-20' ELSE '21+' END AS length_bin, regexp_matches(query_text, '<(MONEY|DATE|PHONE|URL|ID)>')::INTEGER::VARCHAR AS has_placeholder FROM (SELECT *, len(regexp_extract_all(query_text, '[\\p{L}\\p{M}\\p{N}_]+')) AS n FROM queries)"
query(
    "quality_slices",
    S.sql("SELECT CASE WHEN grouping(length_bin) = 0 THEN 'length_bin' ELSE 'has_placeholder' END AS slice, CASE WHEN grouping(length_bin) = 0 THEN length_bin ELSE has_placeholder END AS value, count(*) AS n, round(avg(ap), 6) AS map, round(avg((first_rank > 10)::INTEGER::DOUBLE), 6) AS miss FROM pq JOIN flags USING (query_id) GROUP BY GROUPING SETS ((length_bin), (has_placeholder))", "pq", "queries", flags=_flags),
)(lambda x: diagnostics.quality_slices(x.per_query, diagnostics.query_flags(x.queries)))
query(
    "novelty",
    S.sql("SELECT k AS novelty, count(*) AS n, round(avg(ap), 6) AS map FROM pq JOIN (SELECT query_id, CASE WHEN min(seen) = 1 THEN 'all_seen' WHEN max(seen) = 0 THEN 'all_unseen' ELSE 'part_seen' END AS k FROM (SELECT query_id, (count(*) OVER (PARTITION BY article_id) > count(*) OVER (PARTITION BY article_id, fold))::INTEGER AS seen FROM labels_t JOIN splits USING (query_id) WHERE fold IS NOT NULL) GROUP BY query_id) USING (query_id) GROUP BY k", "pq", "labels_t", "splits"),
)(lambda x: diagnostics.novelty(x.per_query, x.labels, x.splits))
query(
    "fold_metrics",
    S.sql("SELECT fold, count(*) AS n, round(avg(f.ap), 6) AS map, sum((f.first_rank > 10)::INTEGER)::BIGINT AS misses, round(avg(f.ap - b.ap), 6) AS delta FROM pq_f f JOIN pq b USING (query_id) JOIN splits USING (query_id) WHERE fold IS NOT NULL GROUP BY fold", "pq", "pq_f", "splits"),
)(lambda x: diagnostics.fold_metrics(x.per_query_both[1], x.splits, x.per_query_both[0]))
query(
    "frequency_bins",
    S.sql("SELECT CASE WHEN f = 0 THEN '0' WHEN f = 1 THEN '1' WHEN f <= 3 THEN '2-3' ELSE '4+' END AS bin, count(*) AS n, round(avg(ap), 6) AS map FROM pq JOIN (SELECT query_id, max(f) AS f FROM (SELECT query_id, count(*) OVER (PARTITION BY article_id) - count(*) OVER (PARTITION BY article_id, fold) AS f FROM labels_t JOIN splits USING (query_id) WHERE fold IS NOT NULL) GROUP BY query_id) USING (query_id) GROUP BY bin", "pq", "labels_t", "splits"),
)(lambda x: diagnostics.frequency_bins(x.per_query, x.labels, x.splits))
query("hit_by_rank", S.sql("SELECT gt_type, rank, count(*) AS n, round(avg((l.article_id IS NOT NULL)::INTEGER::DOUBLE), 6) AS hit_rate FROM bm25_top b JOIN (SELECT query_id, CASE WHEN count(*) = 1 THEN 'single' ELSE 'multi' END AS gt_type FROM labels_t GROUP BY query_id) USING (query_id) LEFT JOIN labels_t l ON l.query_id = b.query_id AND l.article_id = b.article_id GROUP BY ALL", "bm25_top", "labels_t"))(
    lambda x: diagnostics.hit_by_rank(rank.top_k(x.bm25, 10), x.labels)
)
query("popularity_topk", S.sql("SELECT article_id, freq, row_number() OVER (ORDER BY freq DESC, article_id) - 1 AS rank FROM (SELECT article_id, coalesce(freq, 0) AS freq FROM corpus LEFT JOIN freq USING (article_id) ORDER BY 2 DESC, 1 LIMIT 20)", "corpus", "freq"))(
    lambda x: rank.popularity(graph.label_frequency(x.labels), x.corpus, 20)
)
query("popularity_rerank", S.sql("SELECT query_id, article_id, coalesce(freq, 0) AS freq, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(freq, 0) DESC, rank) - 1 AS rank FROM bm25_top LEFT JOIN freq USING (article_id)", "bm25_top", "freq"))(
    lambda x: rank.popularity_rerank(rank.top_k(x.bm25, 10), graph.label_frequency(x.labels))
)
query(
    "concentration",
    S.sql("SELECT count(*) AS distinct_top1, round(sum(CASE WHEN coalesce(freq, 0) > 0 THEN p ELSE 0 END), 6) AS known_share, round(max(p), 6) AS max_share, round(sum(p * p), 6) AS hhi, (SELECT count(DISTINCT article_id) FROM bm25_top) AS distinct_top10 FROM (SELECT article_id, count(*) / (sum(count(*)) OVER ())::DOUBLE AS p FROM bm25_top WHERE rank = 0 GROUP BY article_id) LEFT JOIN freq USING (article_id)", "bm25_top", "freq"),
)(lambda x: diagnostics.concentration(rank.top_k(x.bm25, 10), graph.label_frequency(x.labels)))
query("top1_composition", S.sql("SELECT sum((coalesce(freq, 0) = 0)::INTEGER)::BIGINT AS unlabelled, sum((coalesce(freq, 0) = 1)::INTEGER)::BIGINT AS once, sum((coalesce(freq, 0) > 1)::INTEGER)::BIGINT AS frequent FROM bm25_top LEFT JOIN freq USING (article_id) WHERE rank = 0", "bm25_top", "freq"))(
    lambda x: diagnostics.composition(rank.top_k(x.bm25, 10), graph.label_frequency(x.labels))
)
query("head_tail", S.sql("SELECT article_id, freq, row_number() OVER w - 1 AS place, round(sum(freq) OVER w / (SELECT sum(freq) FROM freq)::DOUBLE, 6) AS cum_share FROM freq WINDOW w AS (ORDER BY freq DESC, article_id ROWS UNBOUNDED PRECEDING)", "freq"))(lambda x: diagnostics.head_tail(graph.label_frequency(x.labels)))
query("regressions", S.sql("SELECT query_id, b.ap AS before, a.ap AS after, round(a.ap - b.ap, 6) AS delta FROM (SELECT query_id, round(ap, 6) AS ap FROM pq) b JOIN (SELECT query_id, round(ap, 6) AS ap FROM pq_f) a USING (query_id) ORDER BY delta, query_id LIMIT 20", "pq", "pq_f"))(
    lambda x: diagnostics.regressions(*(r6(p, "ap") for p in x.per_query_both))
)


def models(x: Lab) -> DataFrame:
    return fusion.tag(x.sources).withColumn("fold", F.when(F.col("source") == "bm25", 0).otherwise(1))


def ensemble(x: Lab, how: str) -> DataFrame:
    if x.passing is None:
        return fusion.ensemble(models(x), how)
    if how == "rr":
        return x.passing.mean_reciprocal_rank()
    if how == "mean":
        return x.passing.single(lambda s: board.listed_mean(s, s))
    return x.board.mean_zscore()


_models = {"mean": "score", "z": "(score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-6)", "rr": "1 / (row_number() OVER (PARTITION BY source, query_id ORDER BY round(score, 6) DESC, article_id))::DOUBLE"}
for _how, _expr in _models.items():
    query(f"ensemble_{_how}", S.sql(f"SELECT query_id, article_id, round(avg(v), 6) AS score FROM (SELECT *, {_expr} AS v FROM src WINDOW w AS (PARTITION BY source, query_id)) GROUP BY ALL", "src"))(
        lambda x, how=_how: r6(ensemble(x, how))
    )
query("ensemble_subsets", S.sql("SELECT subset, query_id, article_id, round(avg(score), 6) AS score FROM src, (VALUES (1), (2), (3)) m(subset) WHERE (subset >> CASE source WHEN 'bm25' THEN 0 ELSE 1 END) & 1 = 1 GROUP BY ALL", "src").replace("SELECT subset,", "SELECT subset::BIGINT AS subset,"))(
    lambda x: r6(fusion.ensemble_subsets(models(x), 2) if x.passing is None else x.passing.subsets())
)
query("spearman", S.sql("SELECT round(corr(ra, rb), 6) AS rho FROM (SELECT rank() OVER (ORDER BY n_rel) + (count(*) OVER (PARTITION BY n_rel) - 1) / 2e0 AS ra, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2e0 AS rb FROM (SELECT n_rel, round(ap, 6) AS a FROM pq))", "pq"))(lambda x: diagnostics.spearman(r6(x.per_query, "ap").select("n_rel", "ap"), "n_rel", "ap"))
query("component_effect")(lambda x: diagnostics.component_effect(*x.per_query_both, x.labels, graph.components(graph.co_labels(x.labels).select(F.col("a").alias("src"), F.col("b").alias("dst")))))
query("unknown_tokens", S.sql(f"SELECT query_id, list(term ORDER BY term) AS unknown FROM (SELECT DISTINCT query_id, term FROM q_terms WHERE term NOT IN (SELECT term FROM tf)) GROUP BY query_id", "q_terms", "tf"))(
    lambda x: diagnostics.unknown_tokens(x.queries, lexical.weighted_terms(x.corpus, wanted=lexical.query_terms(x.queries).select("term").distinct()))
)

# ---- answers, contracts, runs, variants ------------------------------------------------------------

query("answer", S.sql("SELECT query_id, coalesce(answer, '') AS answer FROM (SELECT DISTINCT query_id FROM queries) LEFT JOIN (SELECT query_id, string_agg(article_id::VARCHAR, ' ' ORDER BY rank) AS answer FROM blend_r WHERE rank < 10 GROUP BY query_id) USING (query_id)", "queries", "blend_r"))(
    lambda x: answers.build_answers(rank.top_k(x.blend, 10), x.queries)
)
query("answer_profile", S.sql("SELECT min(n)::BIGINT AS min_ids, quantile_cont(n, 0.5) AS median_ids, max(n)::BIGINT AS max_ids FROM (SELECT count(rank) AS n FROM (SELECT DISTINCT query_id FROM queries) LEFT JOIN bm25_top USING (query_id) GROUP BY query_id)", "queries", "bm25_top"))(
    lambda x: answers.answer_profile(answers.build_answers(rank.top_k(x.bm25, 10), x.queries))
)
query("answer_titles", S.sql("SELECT query_id, string_agg(article_id || ': ' || title, ' | ' ORDER BY rank) AS titles FROM bm25_top JOIN corpus USING (article_id) GROUP BY query_id", "bm25_top", "corpus"))(lambda x: answers.render_titles(rank.top_k(x.bm25, 10), x.corpus))


def _count(rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, (SELECT count(*) FROM ({rows})) AS violations" for rule, rows in rules.items())


_UNKNOWN = "SELECT 1 FROM {0} ANTI JOIN corpus ON corpus.article_id = {0}.article_id"
_TWICE = "SELECT 1 FROM {0} GROUP BY query_id, article_id HAVING count(*) > 1"
_PLANTED_SCORES = """SELECT query_id, article_id, score FROM bm25 UNION ALL SELECT query_id, article_id, score FROM bm25 WHERE article_id % 7 = 0
UNION ALL SELECT query_id, -1 - query_id, 1e0 FROM queries WHERE query_id % 3 = 0 UNION ALL SELECT query_id, 0, CASE WHEN query_id % 2 = 0 THEN 'NaN'::DOUBLE END FROM queries WHERE query_id % 5 = 0"""
_PLANTED_FRAME = """SELECT query_id, article_id, rank + CASE WHEN query_id % 4 = 0 THEN 1 ELSE 0 END AS rank FROM bm25_r WHERE rank < 20
UNION ALL SELECT query_id, article_id, rank FROM bm25_r WHERE rank < 20 AND query_id % 5 = 0 AND rank = 3 UNION ALL SELECT query_id, -1 - query_id, 20 FROM queries WHERE query_id % 3 = 0"""


def _faulty_scores(x: Lab) -> DataFrame:
    """BM25 scores with planted faults: pairs twice, unknown articles, scores that are NaN or null."""
    q = F.col("query_id")
    extra = x.queries.where(q % 3 == 0).select("query_id", (-1 - q).alias("article_id"), F.lit(1.0).alias("score"))
    bad = x.queries.where(q % 5 == 0).select("query_id", F.lit(0).cast("bigint").alias("article_id"), F.when(q % 2 == 0, F.lit(float("nan"))).alias("score"))
    return x.bm25.union(x.bm25.where("article_id % 7 = 0")).union(extra).union(bad)


def _faulty_frame(x: Lab) -> DataFrame:
    """A retrieval frame with planted faults: shifted ranks, rows twice, unknown articles."""
    q, frame = F.col("query_id"), rank.retrieval_frame(x.bm25, 20, "bm25")
    shifted = frame.withColumn("rank", F.col("rank") + F.when(q % 4 == 0, 1).otherwise(0))
    extra = x.queries.where(q % 3 == 0).select("query_id", (-1 - q).alias("article_id"), F.lit(0.0).alias("score"), F.lit(20).cast("bigint").alias("rank"), F.lit("bm25").alias("source"))
    return shifted.union(frame.where((q % 5 == 0) & (F.col("rank") == 3))).union(extra)


def _faulty_answers(x: Lab) -> DataFrame:
    """Answers with a planted fault by query: left out, twice, empty, too long with repeats, unknown or unreadable ids."""
    r = F.col("query_id") % 7
    ids = F.when(r == 2, "").when(r == 3, "0 1 2 3 4 5 6 7 8 9 0 1").when(r == 4, "1 -5").when(r == 5, " 2  x ").otherwise("1 2")
    rows = x.queries.select("query_id", ids.alias("answer")).where(r != 0)
    return rows.union(rows.where(F.col("query_id") % 7 == 1)).union(x.queries.where(r == 6).select(F.col("query_id") + 100_000, F.lit("1")))


_PLANTED_ANSWERS = """SELECT query_id, CASE query_id % 7 WHEN 2 THEN '' WHEN 3 THEN '0 1 2 3 4 5 6 7 8 9 0 1' WHEN 4 THEN '1 -5' WHEN 5 THEN ' 2  x ' ELSE '1 2' END AS answer, n
FROM queries, (VALUES (1), (2)) v(n) WHERE query_id % 7 <> 0 AND (n = 1 OR query_id % 7 = 1) UNION ALL SELECT query_id + 100000, '1', 1 FROM queries WHERE query_id % 7 = 6"""
_ANSWER_IDS = "SELECT query_id, list_filter(string_split(answer, ' '), lambda w: w <> '') AS ids FROM planted"
query("contract_violations", S.sql(_count({
    "unique_queries": "SELECT 1 FROM planted GROUP BY query_id HAVING count(*) > 1",
    "missing_queries": "SELECT 1 FROM queries ANTI JOIN planted USING (query_id)",
    "extra_queries": "SELECT 1 FROM planted ANTI JOIN queries USING (query_id)",
    "empty_answers": "SELECT 1 FROM split WHERE len(ids) = 0",
    "long_answers": "SELECT 1 FROM split WHERE len(ids) > 10",
    "repeated_ids": "SELECT 1 FROM split WHERE len(list_distinct(ids)) < len(ids)",
    "unknown_ids": "SELECT 1 FROM (SELECT unnest(ids) AS a FROM split) WHERE NOT coalesce(try_cast(a AS BIGINT) IN (SELECT article_id FROM corpus), false)",
}), "queries", "corpus", planted=_PLANTED_ANSWERS, split=_ANSWER_IDS))(lambda x: contracts.answer_violations(_faulty_answers(x), x.queries, x.corpus))
query("score_contract", S.sql(_count({"finite_scores": "SELECT 1 FROM planted WHERE score IS NULL OR NOT isfinite(score)", "unique_pairs": _TWICE.format("planted"), "known_articles": _UNKNOWN.format("planted")}), "bm25", "queries", "corpus", planted=_PLANTED_SCORES))(
    lambda x: contracts.score_violations(_faulty_scores(x), x.corpus)
)
query("retrieval_contract", S.sql(_count({"unique_pairs": _TWICE.format("planted"), "known_articles": _UNKNOWN.format("planted"), "dense_ranks": "SELECT 1 FROM planted GROUP BY query_id HAVING min(rank) <> 0 OR max(rank) <> count(*) - 1 OR count(DISTINCT rank) <> count(*)"}), "bm25_r", "queries", "corpus", planted=_PLANTED_FRAME))(
    lambda x: contracts.retrieval_violations(_faulty_frame(x), x.corpus)
)
query("aligned_sources", S.sql("SELECT source, (SELECT count(*) FROM (SELECT DISTINCT query_id, article_id FROM src)) - count(*) AS missing FROM src GROUP BY source", "src"))(lambda x: contracts.same_pairs(x.sources) if x.passing is None else x.passing.missing())


def _runs(x: Lab) -> DataFrame:
    """Runs of settings, retriever and split, told from the events: each event is one measurement of its key."""
    e = x.table("events")
    return e.select((F.col("user_id") % 12).cast("string").alias("config_hash"), F.col("event_type").alias("retriever"), F.when(F.col("event_id") % 3 == 0, "holdout").otherwise("dev").alias("split"), F.col("event_id").alias("created_at"), F.round(F.col("value") / 100, 6).alias("map"))


_RUNS_SQL = "(SELECT (user_id % 12)::VARCHAR AS config_hash, event_type AS retriever, CASE WHEN event_id % 3 = 0 THEN 'holdout' ELSE 'dev' END AS split, event_id AS created_at, round(value / 100, 6) AS map FROM events)"
_RUN_KEY = ["config_hash", "retriever", "split"]
_LATEST = f"SELECT * FROM {_RUNS_SQL} QUALIFY row_number() OVER (PARTITION BY config_hash, retriever, split ORDER BY created_at DESC) = 1"
query("experiments_latest", _LATEST)(lambda x: sinks.upsert(_runs(x).where("created_at % 2 = 0"), _runs(x).where("created_at % 2 = 1"), _RUN_KEY))
query("runs_ranked", f"SELECT *, row_number() OVER (ORDER BY map DESC, config_hash, retriever, split) AS place FROM ({_LATEST})")(
    lambda x: stages.compare([_runs(x).where(f"created_at % 3 = {k}") for k in range(3)]).selectExpr("*", "row_number() over (order by map desc, config_hash, retriever, split) as place").withColumn("place", F.col("place").cast("bigint"))
)


@query("run_catalogue", f"SELECT config_hash, retriever, split, created_at, map, split || '.csv' AS file FROM {_RUNS_SQL} WHERE map > 0.05")
def run_catalogue(x: Lab) -> DataFrame:
    """Runs written as CSV files by split, some without a metric, found again by a path pattern."""
    graph.ensure_checkpoints(x.spark)
    root = f"{x.spark.sparkContext.getCheckpointDir()}/runs-{uuid.uuid4().hex}"
    rows = _runs(x).withColumn("map", F.when(F.col("map") > 0.05, F.col("map")))
    for split in ("dev", "holdout"):
        rows.where(F.col("split") == split).write.option("header", True).csv(f"{root}/{split}.csv")
    found = tables.run_catalogue(x.spark, f"{root}/*.csv", "config_hash string, retriever string, split string, created_at bigint, map double")
    return found.withColumn("file", F.regexp_extract("file", "/([a-z]+[.]csv)/", 1))


_VARIANTS = f"""SELECT query_id, 'original' AS variant, query_text FROM queries UNION ALL
SELECT query_id, 'polite_noise', '{perturb.POLITE_PREFIX}' || query_text FROM queries UNION ALL
SELECT query_id, 'topic_distractor', query_text || '{perturb.DISTRACTOR}' FROM queries UNION ALL
SELECT query_id, 'mask_entities', regexp_replace(regexp_replace(query_text, '<(?:MONEY|DATE|PHONE|URL|ID)>', '<ENTITY>', 'g'), '[0-9]+(?:[.,][0-9]+)?', '<NUMBER>', 'g') FROM queries"""
query("variants_static", S.sql(_VARIANTS, "queries"))(lambda x: perturb.variants(x.queries, perturb.STATIC))
query("variants_typo", S.sql(S.variants_sql(), "queries"))(lambda x: perturb.variants(x.queries, perturb.RANDOM))


def _variant_scores(x: Lab) -> DataFrame:
    """Fixed candidates and passages, re-scored for every static variant (one key holds query and variant)."""
    return tuning.score_variants(perturb.variants(x.queries, perturb.STATIC), x.candidates, x.passages)


_vscored = f"SELECT query_id, variant, article_id, max(CASE WHEN len(qs) > 0 THEN len(list_intersect(qs, ps)) / len(qs)::DOUBLE ELSE 0 END) AS score FROM (SELECT query_id, variant, article_id, {S.word_set('query_text')} AS qs, {S.word_set('text')} AS ps FROM cand JOIN chunk_t USING (article_id) JOIN vars USING (query_id)) GROUP BY ALL"
_vctes = dict(vars=_VARIANTS, vs=_vscored, vr=S.ranked("vs", "query_id, variant"), vq="SELECT query_id, variant FROM vars", vp=S.per_query("vr", "vq", by="query_id, variant"))
query("variant_scores", S.sql("SELECT query_id, variant, article_id, round(score, 6) AS score FROM vs", "cand", "chunk_t", "queries", **{k: _vctes[k] for k in ("vars", "vs")}))(lambda x: r6(_variant_scores(x)))
query(
    "variant_summary",
    S.sql("SELECT variant, count(*) AS n, round(avg(ap), 6) AS map, round(avg(ap - base), 6) AS delta, round(avg((first_rank > 10)::INTEGER::DOUBLE), 6) AS miss FROM vp JOIN (SELECT query_id, ap AS base FROM vp WHERE variant = 'original') USING (query_id) GROUP BY variant", "cand", "chunk_t", "queries", "labels_t", **_vctes),
)(lambda x: diagnostics.variant_summary(metrics.per_query(rank.with_rank(_variant_scores(x), ("query_id", "variant")), x.labels, perturb.variants(x.queries, perturb.STATIC).select("query_id", "variant"), by=("query_id", "variant"))))

# ---- fits and resampling (no SQL form; tests hold them against closed forms) -----------------------


def _head_rows(x: Lab) -> DataFrame:
    return fusion.label_features(rerank.blend_features(x.candidates.drop("rank"), x.reranked), x.labels)


_NAMES = ("fusion_norm", "fusion_rr", "rerank_norm", "rerank_rr")


@query("lr_fit")
def lr_fit(x: Lab) -> DataFrame:
    head = ltr.fit_logistic(_head_rows(x), _NAMES)
    return x.spark.createDataFrame([("bias", round(head.bias, 4)), *((n, round(c, 4)) for n, c in zip(head.names, head.coef))], "name string, value double")


@query("mlp_fit")
def mlp_fit(x: Lab) -> DataFrame:
    rows = _head_rows(x).orderBy("query_id", "article_id").toPandas()  # 30 candidates a labelled query
    m = DEFAULTS["ranking"]["mlp"]
    net = ltr.ListwiseNetwork(m["hidden"], m["epochs"], m["rate"], m["decay"]).fit(rows[list(_NAMES)].to_numpy(float), rows["label"].to_numpy(), rows["query_id"].to_numpy())
    rows["score"] = np.round(net.predict(rows[list(_NAMES)].to_numpy(float)), 6)
    return x.spark.createDataFrame(rows[["query_id", "article_id", "score"]])


@query("bootstrap_ci")
def bootstrap(x: Lab) -> DataFrame:
    low, high = stats.bootstrap_ci(stats.values(x.per_query, "ap")[:, 0])
    return x.spark.createDataFrame([(low, high)], "low double, high double")


@query("bootstrap_distributed")
def bootstrap_distributed(x: Lab) -> DataFrame:
    return stats.interval(stats.bootstrap_table(x.per_query, "ap", DEFAULTS["evaluation"]["resamples"]))


@query("permutation_p")
def permutation(x: Lab) -> DataFrame:
    before, after = x.per_query_both
    both = before.select("query_id", "ap").join(after.select("query_id", F.col("ap").alias("ap_fused")), "query_id")
    v = stats.values(both, "ap", "ap_fused")
    return x.spark.createDataFrame([(stats.permutation_p(v[:, 0], v[:, 1]),)], "p double")


@query("fold_model_scores")
def fold_model_scores(x: Lab) -> DataFrame:
    """Every fold's fitted re-ranker on every candidate, not averaged: fitted on the best chunks of candidates
    and labelled articles, all chunks scored."""
    scores, _ = tuning.fold_scores(x.candidates, x.passages, x.queries, x.labels, x.splits, n_negatives=DEFAULTS["reranker"]["negatives"], training=rerank.training_passages(x.candidates, x.labels, x.chunks_of(x.candidates, x.labels), x.queries))
    return r6(scores)
