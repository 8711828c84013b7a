"""Article graphs (links, shared labels, vectors) and the features of candidates against leaders."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import rank


def link_edges(articles: DataFrame, html: str = "body", pattern: str = r"/articles/(\d+)") -> DataFrame:
    """(src, dst), both ways: links of raw HTML between known, different articles."""
    ids = articles.select("article_id")
    out = articles.select(F.col("article_id").alias("src"), F.explode(T.article_links(html, pattern)).alias("dst")).where("dst is not null and src <> dst")
    known = out.join(ids, out.dst == ids.article_id, "left_semi")
    return known.union(known.select("dst", "src")).distinct()


def shared_target_edges(links: DataFrame) -> DataFrame:
    """(src, dst), src < dst, chains of pages that share a link target (page_id, target): each page is tied
    to the least page of the target, which keeps components without pairing all pages."""
    least = links.groupBy("target").agg(F.min("page_id").alias("src"))
    return links.join(least, "target").where("src < page_id").select("src", F.col("page_id").alias("dst")).distinct()


def co_labels(labels: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """(a, b, w): queries that label both, both ways, a <> b."""
    rows = labels.select("query_id", "article_id").distinct()
    if articles is not None:
        rows = rows.join(articles.select("article_id"), "article_id", "left_semi")
    left, right = rows.select("query_id", F.col("article_id").alias("a")), rows.select("query_id", F.col("article_id").alias("b"))
    return left.join(right, "query_id").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("w"))


def label_frequency(labels: DataFrame) -> DataFrame:
    return labels.select("query_id", "article_id").distinct().groupBy("article_id").agg(F.count("*").alias("freq"))


def graph_features(reranked: DataFrame, labels: DataFrame, links: DataFrame, vectors: DataFrame, top_m: int = 3, conditional: bool = True, interaction: bool = True) -> DataFrame:
    """Features of each candidate (query_id, article_id, score) against its query's ``top_m`` leaders.

    co_top_p (or co_top_w), link_top, sim_top, gt_freq, co_x_margin. For queries among ``labels`` their own
    label pairs and counts are taken out of the graph (leave one out) by a second join."""
    own = labels.select("query_id", "article_id").distinct().withColumn("own", F.lit(1))
    freq, co = label_frequency(labels), co_labels(labels)
    cand = reranked.select("query_id", "article_id", "score")
    leaders = rank.top_k(cand, top_m).select("query_id", F.col("article_id").alias("leader"))
    base = cand.join(own, ["query_id", "article_id"], "left").join(freq, "article_id", "left").select("query_id", "article_id", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("freq", F.lit(0)).alias("freq"))
    anchors = (
        leaders.join(own.select("query_id", F.col("article_id").alias("leader"), F.col("own").alias("l_own")), ["query_id", "leader"], "left")
        .join(freq.select(F.col("article_id").alias("leader"), F.col("freq").alias("l_freq")), "leader", "left")
        .join(vectors.select(F.col("article_id").alias("leader"), F.col("vec").alias("l_vec")), "leader", "left")
        .select("query_id", "leader", F.coalesce("l_own", F.lit(0)).alias("l_own"), F.coalesce("l_freq", F.lit(0)).alias("l_freq"), "l_vec")
    )
    pairs = (
        base.join(vectors, "article_id", "left")
        .join(anchors, "query_id")
        .where("article_id <> leader")
        .join(co.select(F.col("a").alias("article_id"), F.col("b").alias("leader"), "w"), ["article_id", "leader"], "left")
        .join(links.select(F.col("src").alias("article_id"), F.col("dst").alias("leader"), F.lit(1).alias("linked")), ["article_id", "leader"], "left")
    )
    w = F.coalesce("w", F.lit(0)) - F.col("own") * F.col("l_own")
    f = F.col("l_freq") - F.col("l_own")
    co_value = F.when(f > 0, F.greatest(w, F.lit(0)) / F.greatest(f, F.lit(1))).otherwise(0.0) if conditional else w.cast("double")
    joined = pairs.groupBy("query_id", "article_id").agg(
        F.max(co_value).alias("co"), F.max(F.coalesce("linked", F.lit(0))).cast("double").alias("link_top"), F.max(F.coalesce(T.dot(F.col("vec"), F.col("l_vec")), F.lit(0.0))).alias("sim_top")
    )
    name = "co_top_p" if conditional else "co_top_w"
    co_final = F.coalesce("co", F.lit(0.0)) if conditional else F.ln(1 + F.greatest(F.coalesce("co", F.lit(0.0)), F.lit(0.0)))
    out = base.join(joined, ["query_id", "article_id"], "left").join(rank.margins(cand), "query_id")
    cols = [co_final.alias(name), F.coalesce("link_top", F.lit(0.0)).alias("link_top"), F.coalesce("sim_top", F.lit(0.0)).alias("sim_top"), F.ln(1 + F.col("freq") - F.col("own")).alias("gt_freq")]
    if interaction:
        cols.append((co_final * F.col("margin")).alias("co_x_margin"))
    return out.select("query_id", "article_id", *cols)


def ensure_checkpoints(spark: SparkSession) -> None:
    """The cluster's ``spark.checkpoint.dir`` counts. Where none is set, a temporary folder serves a local
    master; on a cluster, whose executors could not read it, that is refused."""
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="siftwell-"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): least node of each component of (src, dst), by label spreading with short-cuts.

    Each round takes the least label among neighbours and then the label's own label, so a chain of n nodes
    takes about log(n) rounds; lineage is cut by a checkpoint every round."""
    ensure_checkpoints(edges.sparkSession)
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct().checkpoint()
    labels = both.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("root")).checkpoint()
    for _ in range(most_rounds):
        near = both.join(labels, both.dst == labels.node).groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        hop = labels.join(near, "node").select("node", F.least("root", "near").alias("root"))
        roots = hop.select(F.col("node").alias("root"), F.col("root").alias("up"))
        nxt = hop.join(roots, "root").select("node", F.least("root", "up").alias("root")).checkpoint()
        moved = nxt.join(labels.withColumnRenamed("root", "old"), "node").where("root <> old").isEmpty()
        labels = nxt
        if moved:
            return labels
    raise RuntimeError("components did not settle")


def distances(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, hops): breadth-first distance from ``roots`` (node) over directed edges (src, dst), however far.

    One round a hop; the nodes seen are checkpointed every round, so plans stay short on long chains."""
    ensure_checkpoints(edges.sparkSession)
    edges = edges.select("src", "dst").distinct().checkpoint()
    seen = front = roots.select("node", F.lit(0).alias("hops")).distinct().checkpoint()
    hop = 0
    while not front.isEmpty():
        hop += 1
        step = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct()
        front = step.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hops")).checkpoint()
        seen = seen.unionByName(front).coalesce(seen.sparkSession.sparkContext.defaultParallelism).checkpoint()
    return seen


def paired_with_top(ranked: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, article_id, rank, paired): 1 if an edge ties the item to one of its query's first k others."""
    tops = ranked.where(F.col("rank") < k).select("query_id", F.col("article_id").alias("leader"))
    ties = edges.select(F.col("a").alias("article_id"), F.col("b").alias("leader"), F.lit(1).alias("tie")).distinct()
    hit = ranked.join(tops, "query_id").where("article_id <> leader").join(ties, ["article_id", "leader"], "left")
    flags = hit.groupBy("query_id", "article_id").agg(F.max(F.coalesce("tie", F.lit(0))).alias("paired"))
    return ranked.join(flags, ["query_id", "article_id"], "left").select("query_id", "article_id", "rank", F.coalesce("paired", F.lit(0)).alias("paired"))


def degree_profile(edges: DataFrame, articles: DataFrame) -> DataFrame:
    """One row: directed edges, articles with a link, isolated ones, largest out-degree."""
    out = edges.groupBy("src").agg(F.count("*").alias("d"))
    full = articles.select(F.col("article_id").alias("src")).join(out, "src", "left")
    return full.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("edges"), F.count("d").alias("linked"), F.count(F.when(F.col("d").isNull(), 1)).alias("isolated"), F.coalesce(F.max("d"), F.lit(0)).alias("max_degree"))


def shared_edges(co: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, w), a < b: label pairs that are links too."""
    return co.where("a < b").join(links.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_semi").select("a", "b", "w")


