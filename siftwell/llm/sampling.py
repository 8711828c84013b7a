"""Bounded samples of labelled documents, for fitting classifiers only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import crc_fold, texts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` training documents of each class (least hash of the id first) as (doc_id, y, text),
    and how many training labels each class has in all. Rows whose crc32 fold is ``held_out`` never enter;
    null ids, null labels and labels other than 0 and 1 are left out; repeated label rows count once; of
    several rows of one id the text of the least hash is taken."""
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (crc_fold("doc_id", modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    counts = {int(r.y): int(r.n) for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    spark = docs.sparkSession
    ids = spark.createDataFrame([(int(r.doc_id), int(r.y)) for r in picked], "doc_id bigint, y int")
    slim = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = slim.join(F.broadcast(ids), "doc_id")  # ids: 2 * per_class rows at most
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")), counts


def platt(score, y, weight, rounds: int = 50, ridge: float = 1e-5) -> tuple[float, float]:
    """(a, b) of sigmoid(a * score + b), by Newton's method on the weighted log loss; a stays positive."""
    import numpy as np

    score, y, weight = (np.asarray(v, float) for v in (score, y, weight))
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    mid, spread = float(np.average(score, weights=weight)), float(score.std()) or 1.0
    x = np.stack([(score - mid) / spread, np.ones_like(score)])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = x @ (weight * (p - y)) + ridge * weight.sum() * w * [1, 0]
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))) @ x.T + ridge * weight.sum() * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    a = max(float(w[0]) / spread, 1e-6)
    return a, float(w[1]) - float(w[0]) / spread * mid
