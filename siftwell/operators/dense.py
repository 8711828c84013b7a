"""Dense retrieval: max-pooled chunk similarity plus a title term, over given or encoded vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T

#: Query vectors up to this many bytes travel with the tasks; more are joined in blocks.
CLOSURE_BYTES = 64 << 20
BLOCK = 4096


def encode(texts: DataFrame, text: str, out: str = "emb", encoder: Callable[[pd.Series], pd.Series] | None = None, prefix: str = "", dim: int = 64) -> DataFrame:
    """Adds vectors: by ``encoder`` (a batch function, loaded once a worker through an iterator UDF), or by
    the word-hashing stub."""
    joined = F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))
    if encoder is None:
        return texts.withColumn(out, T.hashing_embedding(joined, dim))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield encoder(b)

    return texts.withColumn(out, run(joined))


def similarities(queries: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(query_id, keys..., sim): inner products of all queries (query_id, emb) with all rows (keys, emb).

    A stated query set against all rows: queries are grouped into blocks of ``BLOCK`` and each block meets
    each batch of rows in one matrix product. Few query bytes travel with the task; many are joined."""
    ids = [(r.query_id, r.emb) for r in queries.select("query_id", "emb").limit(CLOSURE_BYTES // 512 + 1).collect()]
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = "query_id bigint, " + ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", sim double"
    rows = vectors.select(*keys, "emb")

    def product(qi: np.ndarray, qm: np.ndarray, pdf: pd.DataFrame) -> pd.DataFrame:
        sims = qm @ np.stack(pdf["emb"].to_numpy()).astype(np.float64).T
        out = pd.DataFrame({"query_id": np.repeat(qi, len(pdf))})
        for k in keys:
            out[k] = np.tile(pdf[k].to_numpy(), len(qi))
        out["sim"] = sims.ravel()
        return out

    if sum(8 * len(e) for _, e in ids) <= CLOSURE_BYTES and len(ids) <= CLOSURE_BYTES // 512:
        if not ids:
            return rows.sparkSession.createDataFrame([], schema)
        qi, qm = np.array([q for q, _ in ids], np.int64), np.stack([np.asarray(e, np.float64) for _, e in ids])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for lo in range(0, len(qi) if len(pdf) else 0, BLOCK):
                    yield product(qi[lo : lo + BLOCK], qm[lo : lo + BLOCK], pdf)

        return rows.mapInPandas(run, schema)
    n = max(1, queries.count() // BLOCK)
    parts = max(1, rows.count() // (4 * BLOCK))
    left = queries.select("query_id", F.col("emb").alias("emb"), F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("b"))
    right = rows.select("*", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("g"))

    def pair(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({c: [] for c in ("query_id", *keys, "sim")})
        return product(q["query_id"].to_numpy(np.int64), np.stack(q["emb"].to_numpy()).astype(np.float64), p)

    return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInPandas(pair, schema)


def dense_scores(queries: DataFrame, chunks: DataFrame, titles: DataFrame | None = None, title_weight: float = 0.5) -> DataFrame:
    """(query_id, article_id, score): the best chunk similarity plus ``title_weight`` times the title's."""
    best = similarities(queries, chunks, ["article_id", "chunk_id"]).groupBy("query_id", "article_id").agg(F.max("sim").alias("score"))
    if titles is None:
        return best
    head = similarities(queries, titles, ["article_id"]).groupBy("query_id", "article_id").agg(F.max("sim").alias("t"))
    return best.join(head, ["query_id", "article_id"], "left").select("query_id", "article_id", (F.col("score") + title_weight * F.coalesce("t", F.lit(0.0))).alias("score"))


def top_chunks(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, m: int) -> DataFrame:
    """(query_id, article_id, chunk_rank, chunk_id, sim): the m chunks of each candidate nearest to the query."""
    pairs = candidates.select("query_id", "article_id").distinct().join(queries.select("query_id", F.col("emb").alias("q")), "query_id").join(chunks, "article_id")
    scored = pairs.select("query_id", "article_id", "chunk_id", T.dot(F.col("q"), F.col("emb")).alias("sim"))
    order = Window.partitionBy("query_id", "article_id").orderBy(F.round("sim", 6).desc(), "chunk_id")
    return scored.withColumn("chunk_rank", F.row_number().over(order) - 1).where(F.col("chunk_rank") < m).select("query_id", "article_id", "chunk_rank", "chunk_id", "sim")


def article_vectors(chunks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(article_id, vec): unit vector of the chunks' mean plus the title's vector. Means are taken by
    component with partial sums, so a long article is no long row."""
    parts = chunks.select("article_id", F.posexplode("emb").alias("i", "x")).groupBy("article_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    if titles is not None:
        # One title an article: of repeated rows the greatest component counts, and no component comes twice.
        head = titles.select("article_id", F.posexplode("emb").alias("i", "t")).groupBy("article_id", "i").agg(F.max("t").alias("t"))
        parts = parts.join(head, ["article_id", "i"], "left").select("article_id", "i", (F.col("x") + F.coalesce(F.col("t").cast("double"), F.lit(0.0))).alias("x"))
    vec = parts.groupBy("article_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return vec.select("article_id", T.unit(F.col("v")).alias("vec"))
