"""The staged run: corpus, folds, retrieval, evaluation, fusion, re-ranking, blending, answers.

Every stage writes tables under ``root`` with a manifest and is skipped when settings, seed and inputs are
unchanged. Labelled queries get out-of-fold scores in every learned step; held-out queries get scores of
models fitted on all development queries.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions.html import html_to_text
from siftwell.operators import answers, contracts, corpus, dense, diagnostics, fusion, graph, lexical, ltr, metrics, rank, rerank, splits, stats
from siftwell.plans import config as C
from siftwell.sources import sinks, tables

VERSION = 1


class Run:
    """One configured run over given article, labelled and unlabelled query tables."""

    def __init__(self, spark: SparkSession, root: str, articles: DataFrame, labelled: DataFrame, queries: DataFrame, config: dict[str, Any] | None = None, force: bool = False):
        self.spark, self.root, self.config, self.force = spark, root.rstrip("/"), config or C.load(), force
        self.articles, self.labelled, self.unlabelled = tables.load_articles(articles), tables.load_labelled(labelled), tables.load_queries(queries)

    # ---- storage

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def stage(self, name: str, sections: tuple[str, ...], inputs: tuple[str, ...], outputs: dict[str, Callable[[], DataFrame]]) -> bool:
        """Runs a stage unless it is fresh; says whether it ran."""
        key = C.section_hash(self.config, *sections)
        seen = {i: sinks.read_json(self.spark, f"{self.path(i)}.manifest/manifest.json")["content"] for i in inputs}
        home = f"{self.path(name)}.manifest"
        if not self.force and sinks.is_fresh(self.spark, home, VERSION, key, seen, self.config["seed"]) and all(sinks.exists(self.spark, self.path(o)) for o in outputs):
            return False
        for out, make in outputs.items():
            make().write.mode("overwrite").parquet(self.path(out))
        content = sinks.config_hash([sinks.table_hash(self.read(o)) for o in outputs])
        sinks.write_manifest(self.spark, home, sinks.manifest(name, VERSION, self.config["seed"], key, seen, content=content))
        return True

    # ---- shared roles

    @property
    def labels(self) -> DataFrame:
        return corpus.parse_labels(self.labelled)

    @property
    def all_queries(self) -> DataFrame:
        return self.labelled.select("query_id", "query_text").unionByName(self.unlabelled)

    def tokenize(self) -> Callable[[str], Any]:
        s = self.config["preprocess"]["tokens"]
        return partial(T.tokens, letters=s["letters"], min_length=s["min_length"], stop_words=T.STOP_WORDS if s["stop_words"] else (), placeholders=s["placeholders"])

    def sources(self) -> dict[str, DataFrame]:
        return {n: self.read(f"scores_{n}") for n, s in self.config["retrievers"].items() if s["enabled"]}

    def dev(self) -> DataFrame:
        return self.read("folds").where("fold is not null")

    # ---- stages

    def preprocess(self) -> bool:
        s = self.config["preprocess"]
        body = html_to_text("body", tuple(s["html"]["drop_tags"])) if s["html"]["parser"] else T.html_to_text_pattern("body")
        c = s["chunks"]
        made = lambda: corpus.corpus(self.articles.withColumn("body", body))
        return self.stage("corpus", ("data", "preprocess"), (), {"corpus": made, "chunks": lambda: corpus.chunk_table(self.read("corpus"), c["size"], c["overlap"], c["most"], c["title_prefix"])})

    def make_folds(self) -> bool:
        s = self.config["folds"]
        return self.stage("folds", ("data", "folds"), (), {"folds": lambda: splits.hash_splits(splits.label_counts(self.labelled, self.labels), s["n_splits"], s["holdout"], self.config["seed"])})

    def retrieve(self) -> bool:
        base, q, s = self.read("corpus"), self.all_queries, self.config["retrievers"]
        made: dict[str, Callable[[], DataFrame]] = {}
        if s["bm25"]["enabled"]:
            made["scores_bm25"] = lambda: lexical.bm25_scores(base, q, tokenize=self.tokenize(), **{k: v for k, v in s["bm25"].items() if k != "enabled"})
        if s["char"]["enabled"]:
            made["scores_char"] = lambda: lexical.chargram_scores(base, q, **{k: v for k, v in s["char"].items() if k != "enabled"})
        if s["dense"]["enabled"]:
            dim = s["dense"]["dim"]
            made["chunk_vectors"] = lambda: dense.encode(self.read("chunks"), "text", dim=dim).select("article_id", "chunk_id", "emb")
            made["title_vectors"] = lambda: dense.encode(base, "title", dim=dim).select("article_id", "emb")
            made["scores_dense"] = lambda: dense.dense_scores(dense.encode(q, "query_text", dim=dim), self.read("chunk_vectors"), self.read("title_vectors"), s["dense"]["title_weight"])
        ran = self.stage("scores", ("data", "preprocess", "retrievers"), ("corpus",), made)
        for scores in self.sources().values() if ran else ():
            contracts.enforce(contracts.score_violations(scores, base))
        return ran

    def evaluate(self) -> DataFrame:
        """(source, n_queries, map, recall..., low, high) over the development queries."""
        e = self.config["evaluation"]
        rows = []
        for name, scores in self.sources().items():
            per = metrics.per_query(rank.top_k(scores, max(e["recall_ks"])), self.labels, self.dev(), e["k"], tuple(e["recall_ks"])).persist()
            head = metrics.summary(per, tuple(e["recall_ks"])).first().asDict()
            low, high = stats.bootstrap_ci(stats.values(per, "ap")[:, 0], e["resamples"], e["level"], self.config["seed"])
            rows.append({"source": name, **head, "low": low, "high": high})
            per.unpersist()
        return self.spark.createDataFrame(rows)

    def fuse(self) -> bool:
        s, n, names = self.config["fusion"], self.read("corpus").count(), list(self.sources())
        k, deep = self.config["evaluation"]["k"], s["candidates"]

        def fused() -> DataFrame:
            src = self.sources()
            if s["method"] == "rrf":
                return fusion.reciprocal_rank_fusion(src, s["rrf_k"])
            if s["method"] == "lr":
                rows = fusion.features(src, n, s["ranks"]).persist()
                cols = [c for c in rows.columns if c not in ("query_id", "article_id")]
                lab = fusion.label_features(rows.join(self.dev().select("query_id"), "query_id", "left_semi"), self.labels)
                oof = ltr.out_of_fold(lab, self.dev(), cols, l2=s["l2"])
                rest = ltr.predict(rows, ltr.fit_logistic(lab, cols, l2=s["l2"]))
                return fusion.replace_out_of_fold(rest, oof, self.dev())
            if s["method"] != "weighted_sum":
                raise C.ConfigError(f"unknown fusion {s['method']}")
            oof, _ = fusion.out_of_fold_weights(src, self.labels, self.dev(), s["samples"], k, deep, s["objective"], self.config["seed"], n)
            w = fusion.weight_table(self.spark, names, fusion.weight_samples(len(names), s["samples"], self.config["seed"]))
            best = fusion.best_weights(fusion.evaluate_weights(src, self.labels, self.dev().select("query_id"), w, k, deep, n), w, s["objective"]).first()
            weights = dict(zip(names, best.w)) if best else {m: 1 / len(names) for m in names}
            return fusion.replace_out_of_fold(fusion.weighted_sum(src, weights, n), oof, self.dev())

        return self.stage("fusion", ("data", "preprocess", "folds", "retrievers", "fusion", "evaluation"), ("scores", "folds"), {"scores_fusion": fused, "candidates": lambda: rank.top_k(self.read("scores_fusion"), deep)})

    def rerank(self) -> bool:
        s = self.config["reranker"]

        def scored() -> DataFrame:
            cand = rank.top_k(self.read("scores_fusion"), s["candidates"])
            passages = rerank.best_passages(cand, self.read("chunks"), self.all_queries, s["chunks"])
            return rerank.rerank(cand, passages, self.all_queries, s["backend"])

        return self.stage("rerank", ("data", "preprocess", "folds", "retrievers", "fusion", "reranker", "evaluation"), ("fusion", "corpus"), {"scores_rerank": scored})

    def fold_names(self) -> list[int]:
        return [r.fold for r in self.dev().select("fold").distinct().orderBy("fold").collect()]

    def features(self, train: DataFrame, graph_on: bool | None = None) -> tuple[DataFrame, list[str]]:
        """Candidate features; with graph features, by the labels of the ``train`` queries."""
        rows = rerank.blend_features(rank.top_k(self.read("scores_fusion"), self.config["reranker"]["candidates"]).drop("rank"), self.read("scores_rerank"))
        g = self.config["ranking"]["graph"]
        if g["enabled"] if graph_on is None else graph_on:
            lab = self.labels.join(train.select("query_id"), "query_id", "left_semi")
            vec = dense.article_vectors(dense.encode(self.read("chunks"), "text").select("article_id", "chunk_id", "emb"))
            more = graph.graph_features(self.read("scores_rerank"), lab, graph.link_edges(self.articles), vec, g["top_m"], g["conditional"], g["interaction"])
            rows = rows.join(more, ["query_id", "article_id"])
        return rows, [c for c in rows.columns if c not in ("query_id", "article_id")]

    def blend(self) -> bool:
        s = self.config["ranking"]

        def manual() -> DataFrame:
            cand, re = rank.top_k(self.read("scores_fusion"), self.config["reranker"]["candidates"]).drop("rank"), self.read("scores_rerank")
            parts, chosen = None, lambda dev: rerank.blend_search(cand, re, self.labels, dev, s["grid"], self.config["evaluation"]["k"]).orderBy(F.desc("map"), "wid").first()
            for f in self.fold_names():
                best = chosen(self.dev().where(F.col("fold") != f))
                mine = self.dev().where(F.col("fold") == f).select("query_id")
                part = rerank.manual_blend(cand, re, best.weight if best else 0.5).join(mine, "query_id", "left_semi")
                parts = part if parts is None else parts.unionByName(part)
            best = chosen(self.dev())
            rest = rerank.manual_blend(cand, re, best.weight if best else 0.5)
            return rest if parts is None else fusion.replace_out_of_fold(rest, parts, self.dev())

        def learned(kind: str, graph_on: bool) -> DataFrame:
            """Fold rows by heads (and label graphs) of the other folds, all others by one of all dev queries."""

            def scored(train: DataFrame, target: DataFrame | None) -> DataFrame:
                rows, cols = self.features(train, graph_on)
                lab = fusion.label_features(rows.join(train.select("query_id"), "query_id", "left_semi"), self.labels)
                mine = rows if target is None else rows.join(target.select("query_id"), "query_id", "left_semi")
                if kind == "lr":
                    return ltr.predict_blend(mine, ltr.fit_logistic(lab, cols, l2=s["l2"]))
                m = s["mlp"]
                t = lab.orderBy("query_id", "article_id").toPandas()  # candidates of labelled queries
                net = ltr.ListwiseNetwork(m["hidden"], m["epochs"], m["rate"], m["decay"], self.config["seed"]).fit(t[cols].to_numpy(float), t["label"].to_numpy(), t["query_id"].to_numpy())
                return mine.mapInPandas(lambda it: (b[["query_id", "article_id"]].assign(score=1 + net.predict(b[cols].to_numpy(float))) for b in it if len(b)), "query_id bigint, article_id bigint, score double")

            parts = None
            for f in self.fold_names():
                part = scored(self.dev().where(F.col("fold") != f), self.dev().where(F.col("fold") == f))
                parts = part if parts is None else parts.unionByName(part)
            rest = scored(self.dev(), None)
            return rest if parts is None else fusion.replace_out_of_fold(rest, parts, self.dev())

        def blended() -> DataFrame:
            g = s["graph"]["enabled"]
            ways = {"blend": manual, "lr": lambda: learned("lr", g), "mlp": lambda: learned("mlp", g)}
            if s["method"] in ways:
                return ways[s["method"]]()
            if s["method"] != "auto":
                raise C.ConfigError(f"unknown ranking {s['method']}")
            # The variant of the best out-of-fold MAP; the first of equal ones.
            k, best = self.config["evaluation"]["k"], (-1.0, None)
            for name, make in ways.items():
                made = make().persist()
                value = metrics.per_query(rank.top_k(made, k), self.labels, self.dev(), k).agg(F.avg("ap")).first()[0] or 0.0
                if value > best[0]:
                    best = (value, made)
            return best[1]

        return self.stage("blend", ("data", "preprocess", "folds", "retrievers", "fusion", "reranker", "ranking", "evaluation"), ("rerank", "fusion", "folds"), {"scores_blend": blended})

    def make_answer(self) -> DataFrame:
        x = self.config["export"]
        made = answers.build_answers(rank.top_k(self.read(f"scores_{x['source']}"), x["k"]), self.unlabelled, x["k"])
        sinks.write_answers(made, self.path("answer"))
        sinks.write_text(self.spark, self.path("answer.config.yaml"), C.snapshot(self.config))
        return tables.read_answers(self.spark, self.path("answer"))

    def validate_answer(self) -> DataFrame:
        back = tables.read_answers(self.spark, self.path("answer"))
        contracts.enforce(contracts.answer_violations(back, self.unlabelled, self.read("corpus"), self.config["export"]["k"]))
        return answers.answer_profile(back)

    def record(self) -> DataFrame:
        """Adds this run's development metrics to the experiments table, the latest row of each key."""
        import datetime

        key = C.section_hash(self.config, *C.SECTIONS)
        now = datetime.datetime.now(datetime.timezone.utc).isoformat()
        new = self.evaluate().select(F.lit(key).alias("config_hash"), F.col("source").alias("retriever"), F.lit("dev").alias("split"), F.lit(now).alias("created_at"), "map", "low", "high")
        # A run's table has one row a source: it is read before its files are replaced.
        old = self.spark.createDataFrame(self.read("experiments").collect(), new.schema) if sinks.exists(self.spark, self.path("experiments")) else None
        sinks.upsert(old, new, ["config_hash", "retriever", "split"]).coalesce(1).write.mode("overwrite").parquet(self.path("experiments"))
        return self.read("experiments")

    def holdout(self, source: str = "fusion", budget: int = 3) -> dict[str, float]:
        """Metrics on the held-out queries; every look is logged, and looks are rationed."""
        held = self.read("folds").where("split = 'holdout'")
        e = self.config["evaluation"]
        per = metrics.per_query(rank.top_k(self.read(f"scores_{source}"), e["k"]), self.labels, held, e["k"], (e["k"],))
        out = {k: float(v or 0) for k, v in metrics.summary(per, (e["k"],)).first().asDict().items()}
        sinks.log_access(self.spark, self.path("holdout.log"), source, out, budget)
        return out

    def all(self) -> DataFrame:
        self.preprocess()
        self.make_folds()
        self.retrieve()
        self.fuse()
        if self.config["reranker"]["enabled"]:
            self.rerank()
            self.blend()
        elif self.config["export"]["source"] == "blend":
            self.config = C.merge(self.config, {"export": {"source": "fusion"}})
        self.make_answer()
        return self.validate_answer()


def compare(runs: list[DataFrame], metric: str = "map") -> DataFrame:
    """All runs' tables together, the latest of each key, best first."""
    both = rank.keep_latest(tables.union_runs(runs), ["config_hash", "retriever", "split"], "created_at")
    return both.orderBy(F.col(metric).desc(), "config_hash", "retriever", "split")


def sweep(spark: SparkSession, root: str, articles: DataFrame, labelled: DataFrame, queries: DataFrame, variants: dict[str, list[str]], keep: int | None = None) -> DataFrame:
    """One run a named list of overrides, each in its own folder and resumable; ``keep`` prunes all but the best."""
    rows = []
    for name, overrides in variants.items():
        run = Run(spark, f"{root}/{name}", articles, labelled, queries, C.load(overrides=overrides))
        run.all()
        per = metrics.per_query(rank.top_k(run.read(f"scores_{run.config['export']['source']}"), 10), run.labels, run.dev())
        rows.append((name, *diagnostics.stage_summary(per).first()))
    table = spark.createDataFrame(rows, "name string, n bigint, map double, hit_10 double, mean_first_rank double").orderBy(F.desc("map"), "name")
    if keep is not None:
        sinks.prune(spark, root, {r.name for r in table.limit(keep).collect()})
    return table
