"""Tables that explain rankings: funnels, slices, novelty, concentration, head and tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T


def funnel_stage(in_candidates: str = "found", n_rel: str = "n_rel", top: str = "hits", first: str = "first_rank") -> Column:
    """Of a query with labels: candidate_miss, ranking_miss, partial or perfect."""
    return F.when(F.col(in_candidates) == 0, "candidate_miss").when(F.col(top) == 0, "ranking_miss").when(F.col(top) < F.least(F.col(n_rel), F.lit(10)), "partial").otherwise("perfect")


def funnel(candidates: DataFrame, ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """(stage, n): where labelled queries lose their articles."""
    lab = labels.select("query_id", "article_id").distinct()
    rel = lab.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    found = candidates.join(lab, ["query_id", "article_id"], "left_semi").groupBy("query_id").agg(F.countDistinct("article_id").alias("found"))
    tops = ranked.where("rank < 10").join(lab, ["query_id", "article_id"], "left_semi").groupBy("query_id").agg(F.countDistinct("article_id").alias("hits"))
    rows = rel.join(found, "query_id", "left").join(tops, "query_id", "left").na.fill(0, ["found", "hits"])
    return rows.groupBy(funnel_stage().alias("stage")).agg(F.count("*").alias("n"))


def query_flags(queries: DataFrame) -> DataFrame:
    """(query_id, n_words, n_chars, has_placeholder, length_bin)."""
    words = F.size(F.regexp_extract_all(F.coalesce("query_text", F.lit("")), F.lit(r"(?U)(\w+)"), F.lit(1)))
    return queries.select(
        "query_id", words.cast("bigint").alias("n_words"), F.length(F.coalesce("query_text", F.lit(""))).cast("bigint").alias("n_chars"),
        F.coalesce(F.col("query_text").rlike("<(MONEY|DATE|PHONE|URL|ID)>"), F.lit(False)).cast("int").alias("has_placeholder"), T.length_bin(words).alias("length_bin"),
    )


def unknown_tokens(queries: DataFrame, vocabulary: DataFrame, tokenize=T.tokens) -> DataFrame:
    """(query_id, unknown): distinct query tokens that the vocabulary (term) lacks."""
    rows = queries.select("query_id", F.explode(F.array_distinct(tokenize("query_text"))).alias("term"))
    return rows.join(vocabulary.select("term").distinct(), "term", "left_anti").groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("unknown"))


def quality_slices(per_query: DataFrame, flags: DataFrame, columns: tuple[str, ...] = ("length_bin", "has_placeholder")) -> DataFrame:
    """(slice, value, n, map, miss): quality by each flag in one grouping-sets pass."""
    joined = per_query.join(flags, "query_id").select(*[F.col(c).cast("string").alias(c) for c in columns], "ap", "first_rank")
    joined.createOrReplaceTempView("__slices")
    sets = ", ".join(f"({c})" for c in columns)
    # Of each grouping set exactly one column is grouped by.
    name = " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in columns)
    value = " ".join(f"WHEN grouping({c}) = 0 THEN {c}" for c in columns)
    sql = f"SELECT CASE {name} END AS slice, CASE {value} END AS value, count(*) AS n, round(avg(ap), 6) AS map, round(avg(cast(first_rank > 10 AS double)), 6) AS miss FROM __slices GROUP BY GROUPING SETS ({sets})"
    return joined.sparkSession.sql(sql)


def novelty(per_query: DataFrame, labels: DataFrame, folds: DataFrame) -> DataFrame:
    """(novelty, n, map): queries by whether their articles are labelled in other folds: all, some, none."""
    lab = labels.select("query_id", "article_id").distinct().join(folds.where("fold is not null").select("query_id", "fold"), "query_id")
    total = lab.groupBy("article_id").agg(F.count("*").alias("total"))
    own = lab.groupBy("article_id", "fold").agg(F.count("*").alias("own"))
    seen = lab.join(total, "article_id").join(own, ["article_id", "fold"]).withColumn("seen", (F.col("total") > F.col("own")).cast("int"))
    kind = seen.groupBy("query_id").agg(F.when(F.min("seen") == 1, "all_seen").when(F.max("seen") == 0, "all_unseen").otherwise("part_seen").alias("novelty"))
    return per_query.join(kind, "query_id").groupBy("novelty").agg(F.count("*").alias("n"), F.round(F.avg("ap"), 6).alias("map"))


def fold_metrics(per_query: DataFrame, folds: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(fold, n, map, misses[, delta])."""
    rows = per_query.join(folds.where("fold is not null").select("query_id", "fold"), "query_id")
    cols = [F.count("*").alias("n"), F.round(F.avg("ap"), 6).alias("map"), F.sum((F.col("first_rank") > 10).cast("bigint")).alias("misses")]
    if base is not None:
        rows = rows.join(base.select("query_id", F.col("ap").alias("base_ap")), "query_id")
        cols.append(F.round(F.avg(F.col("ap") - F.col("base_ap")), 6).alias("delta"))
    return rows.groupBy("fold").agg(*cols)


def stage_summary(per_query: DataFrame) -> DataFrame:
    """One row: MAP, share with a hit in ten, mean first rank cut at 51."""
    return per_query.agg(F.count("*").alias("n"), F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg((F.col("first_rank") <= 10).cast("double")), 6).alias("hit_10"), F.round(F.avg(F.least("first_rank", F.lit(51)).cast("double")), 6).alias("mean_first_rank"))


def hit_by_rank(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """(gt_type, rank, n, hit_rate): share of relevant items at each rank for queries of one or more labels."""
    lab = labels.select("query_id", "article_id").distinct()
    kind = lab.groupBy("query_id").agg(F.when(F.count("*") == 1, "single").otherwise("multi").alias("gt_type"))
    marked = ranked.join(kind, "query_id").join(lab.withColumn("hit", F.lit(1.0)), ["query_id", "article_id"], "left")
    return marked.groupBy("gt_type", "rank").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("hit_rate"))


def concentration(ranked: DataFrame, frequencies: DataFrame) -> DataFrame:
    """One row: distinct first and top-ten articles, share of first places on labelled articles, largest
    share of one article and the Herfindahl index of first places."""
    first = ranked.where("rank = 0").groupBy("article_id").agg(F.count("*").alias("n"))
    total = first.agg(F.sum("n").alias("all"))
    shares = first.crossJoin(F.broadcast(total)).join(frequencies, "article_id", "left").select((F.col("n") / F.col("all")).alias("p"), F.coalesce("freq", F.lit(0)).alias("freq"))
    tops = ranked.where("rank < 10").agg(F.countDistinct("article_id").alias("distinct_top10"))
    firsts = shares.agg(F.count("*").alias("distinct_top1"), F.round(F.sum(F.when(F.col("freq") > 0, F.col("p")).otherwise(0.0)), 6).alias("known_share"), F.round(F.max("p"), 6).alias("max_share"), F.round(F.sum(F.col("p") * F.col("p")), 6).alias("hhi"))
    return firsts.crossJoin(F.broadcast(tops))


def composition(ranked: DataFrame, frequencies: DataFrame) -> DataFrame:
    """One row: first places by category of the article: unlabelled, labelled once, labelled more often."""
    f = F.coalesce("freq", F.lit(0))
    return ranked.where("rank = 0").join(frequencies, "article_id", "left").agg(F.sum((f == 0).cast("bigint")).alias("unlabelled"), F.sum((f == 1).cast("bigint")).alias("once"), F.sum((f > 1).cast("bigint")).alias("frequent"))


def head_tail(frequencies: DataFrame) -> DataFrame:
    """(article_id, freq, place, cum_share) by falling frequency. The running sum over all articles is made
    by frequency level first (few levels), then by place inside a level."""
    levels = frequencies.groupBy("freq").agg(F.count("*").alias("n"))
    ahead = Window.orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, -1)  # one row a level
    base = levels.select("freq", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.coalesce(F.sum(F.col("n") * F.col("freq")).over(ahead), F.lit(0)).alias("mass"))
    total = frequencies.agg(F.sum("freq").alias("total"))
    inside = F.row_number().over(Window.partitionBy("freq").orderBy("article_id"))
    rows = frequencies.withColumn("i", inside).join(base, "freq").crossJoin(F.broadcast(total))
    return rows.select("article_id", F.col("freq").cast("bigint").alias("freq"), (F.col("before") + F.col("i") - 1).cast("bigint").alias("place"), F.round((F.col("mass") + F.col("i") * F.col("freq")) / F.col("total"), 6).alias("cum_share"))


def regressions(a: DataFrame, b: DataFrame, n: int = 20) -> DataFrame:
    """The n queries that lose most AP from a to b (ties by id)."""
    return a.select("query_id", F.col("ap").alias("before")).join(b.select("query_id", F.col("ap").alias("after")), "query_id").withColumn("delta", F.round(F.col("after") - F.col("before"), 6)).orderBy("delta", "query_id").limit(n)


def variant_summary(per_variant: DataFrame) -> DataFrame:
    """(variant, n, map, delta, miss) against the variant ``original``."""
    base = per_variant.where("variant = 'original'").select("query_id", F.col("ap").alias("base"))
    rows = per_variant.join(base, "query_id")
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg(F.col("ap") - F.col("base")), 6).alias("delta"), F.round(F.avg((F.col("first_rank") > 10).cast("double")), 6).alias("miss"))


def component_effect(before: DataFrame, after: DataFrame, labels: DataFrame, components: DataFrame) -> DataFrame:
    """(in_giant, n, map_before, map_after, delta): queries whose articles lie in the largest component, and the rest."""
    giant = components.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(1).select("root")
    inside = labels.join(components.join(giant, "root", "left_semi").select(F.col("node").alias("article_id")), "article_id", "left_semi").select("query_id").distinct().withColumn("g", F.lit(1))
    rows = before.select("query_id", F.col("ap").alias("b")).join(after.select("query_id", F.col("ap").alias("a")), "query_id").join(inside, "query_id", "left")
    return rows.groupBy(F.coalesce("g", F.lit(0)).alias("in_giant")).agg(F.count("*").alias("n"), F.round(F.avg("b"), 6).alias("map_before"), F.round(F.avg("a"), 6).alias("map_after"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("delta"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (rho): correlation of mid-ranks; ranks come from value counts, so no global sort of rows."""

    def ranked(c: str) -> DataFrame:
        levels = rows.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        ahead = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)  # one row a distinct value
        return levels.select("v", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) + (F.col("n") + 1) / 2).alias("r"))

    left, right = ranked(a).select(F.col("v").alias(a), F.col("r").alias("ra")), ranked(b).select(F.col("v").alias(b), F.col("r").alias("rb"))
    return rows.join(left, a).join(right, b).agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))


def frequency_bins(per_query: DataFrame, labels: DataFrame, folds: DataFrame) -> DataFrame:
    """(bin, n, map): queries by how often their best known article is labelled in other folds: 0, 1, 2-3, 4+."""
    lab = labels.select("query_id", "article_id").distinct().join(folds.where("fold is not null").select("query_id", "fold"), "query_id")
    total = lab.groupBy("article_id").agg(F.count("*").alias("total"))
    own = lab.groupBy("article_id", "fold").agg(F.count("*").alias("own"))
    seen = lab.join(total, "article_id").join(own, ["article_id", "fold"]).groupBy("query_id").agg(F.max(F.col("total") - F.col("own")).alias("f"))
    kind = F.when(F.col("f") == 0, "0").when(F.col("f") == 1, "1").when(F.col("f") <= 3, "2-3").otherwise("4+")
    return per_query.join(seen, "query_id").groupBy(kind.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("ap"), 6).alias("map"))


def bin_intervals(per_query: DataFrame, bins: DataFrame, value: str = "ap", resamples: int = 2000, level: float = 0.95, seed: int = 42) -> dict[str, tuple[float, float]]:
    """Bootstrap interval of the mean in each bin of (query_id, bin)."""
    from siftwell.operators import stats

    joined = per_query.join(bins.select("query_id", "bin"), "query_id")
    names = [r.bin for r in joined.select("bin").distinct().orderBy("bin").collect()]
    return {b: stats.bootstrap_ci(stats.values(joined.where(F.col("bin") == b), value)[:, 0], resamples, level, seed) for b in names}


def disc_radius(hops: str = "hops") -> Column:
    """Radius of a node in a disc layout by its distance from the root."""
    return F.tanh(0.55 * F.col(hops))


def summary_text(name: str, row, k: int = 10) -> str:
    """One line of a report from a summary row (map, optional low, high, recalls)."""
    d = row.asDict()
    ci = f" [{d['low']:.3f}, {d['high']:.3f}]" if d.get("low") is not None else ""
    recalls = "".join(f" R@{c.removeprefix('recall_')} {v:.3f}" for c, v in d.items() if c.startswith("recall_"))
    return f"{name}: MAP@{k} {d['map']:.3f}{ci}{recalls} (n={d['n_queries']})"
