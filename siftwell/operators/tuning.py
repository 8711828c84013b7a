"""Fitted re-rankers and heads over folds: pair features, fine-tuning, acceptance, hold-out refits, audits.

The built-in fine-tunable scorer is a logistic head over lexical pair features (no neural library is
needed); a neural one registers with :func:`siftwell.operators.rerank.register_backend`.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators import corpus, ltr, metrics, rank, rerank
from siftwell.sources import sinks

PAIR_FEATURES = ("overlap", "bigrams", "cover", "brevity")


def pair_features(pairs: DataFrame, query: str = "query_text", passage: str = "passage") -> DataFrame:
    """Adds PAIR_FEATURES to (query, passage) rows: shared words, shared word pairs, share of the passage
    covered, and 1 / (1 + ln words)."""
    q, p = rerank.word_set(query), rerank.word_set(passage)
    seq = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    two = lambda c: F.array_distinct(F.zip_with(F.slice(seq(c), 1, F.greatest(F.size(seq(c)) - 1, F.lit(0))), F.slice(seq(c), 2, F.greatest(F.size(seq(c)) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    share = lambda a, b: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)
    return pairs.withColumns({"overlap": rerank.lexical_score(query, passage), "bigrams": share(two(query), two(passage)), "cover": share(p, q), "brevity": 1.0 / (1 + F.ln(1.0 + F.size(seq(passage))))})


def group_rows(groups: DataFrame, passages: DataFrame, queries: DataFrame) -> DataFrame:
    """Training groups (query_id, positive_id, negative_ids) as labelled pair rows with features."""
    members = groups.select("query_id", F.explode(F.concat(F.array(F.struct(F.col("positive_id").alias("article_id"), F.lit(1).alias("label"))), F.transform("negative_ids", lambda a: F.struct(a.alias("article_id"), F.lit(0).alias("label"))))).alias("m"))
    rows = members.select("query_id", "m.article_id", "m.label").join(passages, ["query_id", "article_id"]).join(queries.select("query_id", "query_text"), "query_id")
    return pair_features(rows)


def fine_tune(groups: DataFrame, passages: DataFrame, queries: DataFrame, l2: float = 1.0) -> ltr.Logistic:
    return ltr.fit_logistic(group_rows(groups, passages, queries), PAIR_FEATURES, l2=l2)


def tuned_scores(candidates: DataFrame, passages: DataFrame, queries: DataFrame, head: ltr.Logistic) -> DataFrame:
    """(query_id, article_id, score): the best passage under a fitted head."""
    pairs = candidates.select("query_id", "article_id").join(passages, ["query_id", "article_id"]).join(queries.select("query_id", "query_text"), "query_id")
    return pair_features(pairs).groupBy("query_id", "article_id").agg(F.max(head.probability()).alias("score"))


def synthetic_groups(synthetic: DataFrame, articles: DataFrame, candidates: DataFrame, passages: DataFrame, n: int = 7) -> DataFrame:
    """Training groups of another, generated query table (query_id, ground_truth): labels of unknown
    articles are dropped first."""
    labels = corpus.known_only(corpus.parse_labels(synthetic), articles)
    return rerank.training_groups(candidates, labels, passages, n)


def fold_scores(candidates: DataFrame, passages: DataFrame, queries: DataFrame, labels: DataFrame, folds: DataFrame, n_negatives: int = 7, l2: float = 1.0, training: DataFrame | None = None) -> tuple[DataFrame, dict[int, ltr.Logistic]]:
    """(fold, query_id, article_id, score) of every model on every query - not averaged - and the models.
    Fold f's model never sees the labels of fold f; its rows on fold f are the out-of-fold ones.
    A candidate's score is that of its best passage; ``training`` gives the passages to fit on, where those are others.
    Without training groups (no query outside the fold has enough negatives, say) a fold has no model: it is scored
    by the re-ranker as it was before tuning, with a warning."""
    fitted = passages if training is None else training
    heads: dict[int, ltr.Logistic] = {}
    rows = group_rows(rerank.training_groups(candidates, labels, fitted, n_negatives), fitted, queries).persist()
    dealt = folds.where("fold is not null").select("query_id", "fold")
    numbers = sorted(r.fold for r in dealt.select("fold").distinct().collect())
    grouped = {r.fold for r in dealt.join(rows.select("query_id").distinct(), "query_id", "left_semi").select("fold").distinct().collect()}
    for f in numbers:
        if not grouped - {f}:
            warnings.warn(f"fold {f} has no training groups: its scores are those of the re-ranker before tuning", stacklevel=2)
            continue
        train = rows.join(folds.where(F.col("fold") != f).select("query_id"), "query_id", "left_semi")
        heads[f] = ltr.fit_logistic(train, PAIR_FEATURES, l2=l2)
    rows.unpersist()
    pairs = candidates.select("query_id", "article_id").join(passages, ["query_id", "article_id"]).join(queries.select("query_id", "query_text"), "query_id")
    # All models read the same features in one pass.
    every = F.array(*[F.struct(F.lit(f).alias("fold"), (heads[f].probability() if f in heads else F.col("overlap")).alias("score")) for f in numbers])
    scored = pair_features(pairs).select("query_id", "article_id", F.explode(every).alias("m"))
    return scored.groupBy(F.col("m.fold").alias("fold"), "query_id", "article_id").agg(F.max("m.score").alias("score")), heads


def own_fold(scores: DataFrame, folds: DataFrame) -> DataFrame:
    """The out-of-fold rows: each query under the model of its own fold."""
    return scores.join(folds.select("query_id", "fold"), ["query_id", "fold"]).select("query_id", "article_id", "score")


def mean_of_folds(scores: DataFrame) -> DataFrame:
    return scores.groupBy("query_id", "article_id").agg(F.avg("score").alias("score"))


def accepted(tuned: DataFrame, plain: DataFrame, labels: DataFrame, queries: DataFrame, k: int = 10) -> bool:
    """Whether the tuned scores beat the plain ones, strictly, in MAP over ``queries``."""
    value = lambda s: metrics.per_query(rank.top_k(s, k), labels, queries, k).agg(F.avg("ap")).first()[0] or 0.0
    return value(tuned) > value(plain)


def save_head(spark, path: str, head: ltr.Logistic) -> None:
    sinks.write_json(spark, path, {"names": head.names, "coef": head.coef, "bias": head.bias, "mean": head.mean, "scale": head.scale})


def load_head(spark, path: str) -> ltr.Logistic:
    d = sinks.read_json(spark, path)
    return ltr.Logistic(tuple(d["names"]), tuple(d["coef"]), d["bias"], tuple(d["mean"]), tuple(d["scale"]))


def drift(a: ltr.Logistic, b: ltr.Logistic) -> dict[str, float]:
    """How far the coefficients of two heads lie apart, by name."""
    return {n: abs(x - y) for n, x, y in zip(a.names, a.coef, b.coef)} | {"bias": abs(a.bias - b.bias)}


def refit_on(rows: DataFrame, labels: DataFrame, queries: DataFrame, names: tuple[str, ...], l2: float = 1.0) -> ltr.Logistic:
    """A head fitted on the candidate rows of ``queries`` alone (the held-out ones, say)."""
    mine = rows.join(queries.select("query_id"), "query_id", "left_semi")
    marked = mine.join(labels.select("query_id", "article_id").distinct().withColumn("label", F.lit(1)), ["query_id", "article_id"], "left")
    return ltr.fit_logistic(marked.withColumn("label", F.coalesce("label", F.lit(0))), names, l2=l2)


def audit(scores: DataFrame, labels: DataFrame, queries: DataFrame, reported: float, within: float = 5e-5, k: int = 10) -> float:
    """MAP rebuilt from stored out-of-fold scores; raises if it misses the reported value."""
    got = metrics.per_query(rank.top_k(scores, k), labels, queries, k).agg(F.avg("ap")).first()[0] or 0.0
    if abs(got - reported) > within:
        raise AssertionError(f"reported {reported}, rebuilt {got}")
    return got


def score_variants(variants: DataFrame, candidates: DataFrame, passages: DataFrame, mode: str = "fixed", limit: int | None = None, backend: str = "lexical") -> DataFrame:
    """(query_id, variant, article_id, score): variants (query_id, variant, query_text) re-scored over the
    original candidates and passages. Retrieving anew for a variant is another experiment and refused;
    ``limit`` takes the first queries by id, for a trial."""
    if mode != "fixed":
        raise ValueError("only fixed candidates can be re-scored")
    if limit is not None:
        variants = variants.join(variants.select("query_id").distinct().orderBy("query_id").limit(limit), "query_id", "left_semi")
    pairs = candidates.select("query_id", "article_id").join(passages, ["query_id", "article_id"]).join(variants, "query_id")
    return rerank.score_pairs(pairs, backend).groupBy("query_id", "variant", "article_id").agg(F.max("score").alias("score"))
