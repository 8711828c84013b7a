"""Stratified hold-out and folds."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T


def label_counts(queries: DataFrame, labels: DataFrame) -> DataFrame:
    n = labels.select("query_id", "article_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_labels"))
    return queries.select("query_id").distinct().join(n, "query_id", "left").select("query_id", F.coalesce("n_labels", F.lit(0)).alias("n_labels"))


def hash_splits(counts: DataFrame, n_splits: int = 5, holdout: float = 0.2, seed: int = 42) -> DataFrame:
    """(query_id, stratum, split, fold): inside each stratum by label count, in the order of
    md5("seed:query"), the first bround(holdout * n) are held out (fold null), the rest dealt round robin."""
    keyed = counts.withColumn("stratum", T.stratum(F.col("n_labels"))).withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string")).cast("binary")))
    group = Window.partitionBy("stratum")
    rows = keyed.withColumn("n", F.count("*").over(group)).withColumn("rn", F.row_number().over(group.orderBy("key", "query_id")) - 1).withColumn("h", F.bround(F.col("n") * holdout).cast("int"))
    return rows.select(
        "query_id", "stratum", F.when(F.col("rn") < F.col("h"), "holdout").otherwise("dev").alias("split"), F.when(F.col("rn") >= F.col("h"), F.pmod(F.col("rn") - F.col("h"), F.lit(n_splits))).cast("int").alias("fold")
    )


def seeded_splits(counts: Mapping[int, int], n_splits: int = 5, holdout: float = 0.2, seed: int = 42) -> dict[int, int | None]:
    """query -> fold, None if held out, shuffled by one NumPy generator over strata in name order: for
    parity with splits made that way. Works on a small id map."""
    rng, out = np.random.default_rng(seed), {}
    name = lambda n: "1" if n <= 1 else "2" if n == 2 else "3+"
    for stratum in ("1", "2", "3+"):
        ids = np.array(sorted(int(q) for q, n in counts.items() if name(n) == stratum), np.int64)
        if not len(ids):
            continue
        rng.shuffle(ids)
        held = round(holdout * len(ids))
        out |= {int(q): None for q in ids[:held]} | {int(q): i % n_splits for i, q in enumerate(ids[held:])}
    return out


def train_ids(splits: DataFrame, fold: int) -> DataFrame:
    return splits.where((F.col("split") == "dev") & (F.col("fold") != fold)).select("query_id")


def fold_ids(splits: DataFrame, fold: int) -> DataFrame:
    return splits.where(F.col("fold") == fold).select("query_id")


def fold_sizes(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split", "fold").agg(F.count("*").alias("n"))
