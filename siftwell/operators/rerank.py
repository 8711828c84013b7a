"""Re-ranking of candidates: passages, scorers, max-pooling, blends, training groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators import metrics, rank


def word_set(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def lexical_score(query: str = "query_text", passage: str = "passage") -> Column:
    """Share of the query's distinct words that the passage has; 0 without words."""
    q = word_set(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, word_set(passage))) / F.size(q)).otherwise(0.0)


Backend = Callable[[pd.Series, pd.Series], pd.Series]
Listwise = Callable[[str, list[str]], list[float]]
BACKENDS: dict[str, Callable[[], Backend]] = {}
LISTWISE: dict[str, Callable[[], Listwise]] = {}


def register_backend(name: str, build: Callable[[], Backend]) -> None:
    """A neural scorer: ``build()`` runs once a worker and returns a batch function (queries, passages) -> scores."""
    BACKENDS[name] = build


def register_listwise(name: str, build: Callable[[], Listwise]) -> None:
    """A neural scorer that sees all passages of a query at once; ``build()`` runs once a worker process."""
    LISTWISE[name] = build


def build_backend(name: str) -> Column | Callable[[], Backend]:
    if name == "lexical":
        return lexical_score()
    if name not in BACKENDS:
        raise ValueError(f"unknown reranker {name!r}; known: lexical, {', '.join(sorted({*BACKENDS, *LISTWISE}))}")
    return BACKENDS[name]


def score_pairs(pairs: DataFrame, backend: str = "lexical") -> DataFrame:
    """Adds ``score`` to (query_text, passage) rows: a Column for the lexical scorer, an iterator UDF else."""
    built = build_backend(backend)
    if isinstance(built, Column):
        return pairs.withColumn("score", built)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = built()
        for q, p in batches:
            yield model(q, p)

    return pairs.withColumn("score", run("query_text", "passage"))


def score_listwise(pairs: DataFrame, scorer: Callable[[str, list[str]], list[float]]) -> DataFrame:
    """All passages of a query at once (a candidate list is bounded by its depth)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["query_id", "article_id"]].assign(score=scorer(pdf["query_text"].iloc[0], pdf["passage"].tolist()))

    return pairs.groupBy("query_id").applyInPandas(run, "query_id bigint, article_id bigint, score double")


def rerank(candidates: DataFrame, passages: DataFrame, queries: DataFrame, backend: str = "lexical") -> DataFrame:
    """(query_id, article_id, score): the best passage score of each candidate. ``passages``: (query_id,
    article_id, passage) rows, one a chunk; candidates without a passage are left out. A list-wise backend gets
    all passages of a query in one call, any other one pairs."""
    pairs = candidates.select("query_id", "article_id").join(passages, ["query_id", "article_id"]).join(queries.select("query_id", "query_text"), "query_id")
    if backend in LISTWISE:
        build, built = LISTWISE[backend], []

        def scorer(query: str, texts: list[str]) -> list[float]:
            if not built:
                built.append(build())
            return built[0](query, texts)

        scored = score_listwise(pairs, scorer)
    else:
        scored = score_pairs(pairs, backend)
    return scored.groupBy("query_id", "article_id").agg(F.max("score").alias("score"))


def training_passages(candidates: DataFrame, labels: DataFrame, chunks: DataFrame, queries: DataFrame, m: int = 1) -> DataFrame:
    """:func:`best_passages` of the candidates and of every labelled article, found by retrieval or not: a
    label outside the candidates is a training positive too."""
    pair = ["query_id", "article_id"]
    return best_passages(candidates.select(*pair).union(labels.select(*pair)).distinct(), chunks, queries, m)


def masked_norm(scores: DataFrame, out: str = "norm") -> DataFrame:
    """Min-max among the candidates alone."""
    return rank.minmax(scores, None, out=out)


def manual_blend(fusion: DataFrame, reranked: DataFrame, weight: float) -> DataFrame:
    """1 + weight * fusion + (1 - weight) * reranker, both min-max among the candidates."""
    both = blend_features(fusion, reranked)
    return both.select("query_id", "article_id", (1 + weight * F.col("fusion_norm") + (1 - weight) * F.col("rerank_norm")).alias("score"))


def blend_features(fusion: DataFrame, reranked: DataFrame) -> DataFrame:
    """(query_id, article_id, fusion_norm, fusion_rr, rerank_norm, rerank_rr) of the candidates."""
    cand = fusion.join(reranked.select("query_id", "article_id"), ["query_id", "article_id"], "left_semi")
    a = rank.reciprocal_rank(masked_norm(cand, "fusion_norm"), out="fusion_rr").drop("score")
    b = rank.reciprocal_rank(masked_norm(reranked, "rerank_norm"), out="rerank_rr").drop("score")
    return a.join(b, ["query_id", "article_id"])


def blend_search(fusion: DataFrame, reranked: DataFrame, labels: DataFrame, queries: DataFrame, steps: int = 51, k: int = 10) -> DataFrame:
    """(wid, weight, map): MAP of every weight of the grid over labelled queries, in one job."""
    feats = blend_features(fusion, reranked)
    spark = feats.sparkSession
    grid = spark.range(steps).select(F.col("id").cast("int").alias("wid"), (F.col("id") / (steps - 1)).alias("weight"))
    asked = queries.select("query_id").distinct().join(labels.select("query_id").distinct(), "query_id", "left_semi")
    scored = feats.join(asked, "query_id").crossJoin(F.broadcast(grid)).select("wid", "query_id", "article_id", (1 + F.col("weight") * F.col("fusion_norm") + (1 - F.col("weight")) * F.col("rerank_norm")).alias("score"))
    best = rank.top_k(scored, k, by=("wid", "query_id"))
    per = metrics.per_query(best, labels, asked.crossJoin(F.broadcast(grid.select("wid"))), k, (k,), by=("wid", "query_id"))
    return per.groupBy("wid").agg(F.round(F.avg("ap"), 6).alias("map")).join(grid, "wid").select("wid", F.round("weight", 6).alias("weight"), "map")


def hard_negatives(candidates: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """(query_id, article_id, neg_rank): the first n unlabelled candidates in rank order."""
    rest = candidates.join(labels.select("query_id", "article_id"), ["query_id", "article_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("rank", "article_id")
    return rest.withColumn("neg_rank", F.row_number().over(order) - 1).where(F.col("neg_rank") < n).select("query_id", "article_id", "neg_rank")


def training_groups(candidates: DataFrame, labels: DataFrame, passages: DataFrame, n: int = 7) -> DataFrame:
    """(query_id, positive_id, negative_ids): one group a labelled article with a passage; queries short of
    n negatives with a passage give none."""
    have = passages.select("query_id", "article_id").distinct()
    negs = hard_negatives(candidates.join(have, ["query_id", "article_id"], "left_semi"), labels, n)
    packed = negs.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("neg_rank", "article_id"))), lambda x: x["article_id"]).alias("negative_ids")).where(F.size("negative_ids") == n)
    pos = labels.select("query_id", "article_id").distinct().join(have, ["query_id", "article_id"], "left_semi")
    return pos.join(packed, "query_id").select("query_id", F.col("article_id").alias("positive_id"), "negative_ids")


def best_passages(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, m: int = 1) -> DataFrame:
    """(query_id, article_id, chunk_id, passage): each candidate's m chunks that share most query words."""
    pairs = candidates.select("query_id", "article_id").join(queries.select("query_id", "query_text"), "query_id").join(chunks.select("article_id", "chunk_id", F.col("text").alias("passage")), "article_id")
    scored = pairs.withColumn("s", F.round(lexical_score(), 6))
    order = Window.partitionBy("query_id", "article_id").orderBy(F.desc("s"), "chunk_id")
    return scored.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= m).select("query_id", "article_id", "chunk_id", "passage")


def schedule(step: Column, total: int, warmup_ratio: float = 0.1, kind: str = "cosine") -> Column:
    """Learning-rate factor: linear warm-up, then a cosine to zero; or constant."""
    if kind == "constant":
        return F.lit(1.0)
    if kind != "cosine":
        raise ValueError(kind)
    warm = max(1, int(total * warmup_ratio))
    return F.when(step < warm, (step + 1) / F.lit(float(warm))).otherwise(0.5 * (1 + F.cos(F.pi() * (step - warm) / F.lit(float(max(1, total - warm))))))


