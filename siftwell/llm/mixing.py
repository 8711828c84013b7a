"""Temperature mixing of sources, with DataFrame functions only.

Weights: source s with token share p_s gets weight p_s^a / sum(p^a). The exponent a in [0, 1] is bisected
(30 halvings; five levels are evaluated in one job) to the smallest a whose repetition - the most copies
that any source needs while none falls below one copy - is at most ``max_repetition``; or to the largest a
whose entropy (nats) reaches ``target_entropy``; with both, the larger exponent, as repetition is a limit.

Realisation: with a budget of B tokens (default: the least that holds every document once), source s
fills w_s * B tokens from epochs 0, 1, ...; each epoch is a permutation of its documents by md5. The
mixture is cut into blocks of about ``block_tokens`` tokens; each takes the same share of every source, so
every block has the target weights, and its documents are permuted anew.

Prefix sums inside a source run in two steps over ranges of the hash, so no source, however large, is
gathered in one task. A null source is the source ""; null or empty texts count one token; null ids and
repeated rows are documents of their own (identical rows are interchangeable). An empty table gives an
empty mixture.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import materialize

LEVELS = 5  # halvings decided by one job
HALVINGS = 30
SEED = "mix"
MAX_REPETITION = 2.0
BLOCK_TOKENS = 65_536


def token_count(text: Column) -> Column:
    """Words between ASCII white space; one at least."""
    return F.greatest(F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")), F.lit(1)).cast("bigint")


def bisect_exponent(totals: DataFrame, max_repetition: float | None, target_entropy: float | None) -> float:
    """The mixing exponent for per-source token totals (source, tokens)."""
    shares = totals.crossJoin(totals.agg(F.sum("tokens").alias("all"))).select((F.col("tokens") / F.col("all")).alias("p"))  # one row beside

    def at(exponents: list[float]) -> dict[float, tuple[float, float]]:
        rows = (
            shares.select("p", F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a"))
            .groupBy("a")
            .agg(
                F.sum(F.pow("p", "a")).alias("z"),
                F.sum(F.pow("p", "a") * F.ln("p")).alias("zl"),
                (F.max(F.pow("p", F.col("a") - 1)) / F.min(F.pow("p", F.col("a") - 1))).alias("rep"),
            )
            .collect()  # one row an exponent
        )
        return {r.a: (r.rep, math.log(r.z) - r.a * r.zl / r.z) for r in rows}

    def search(fits, rising: bool) -> float:
        """rising: small exponents fail and large ones fit; the smallest that fits is wanted. Else the largest."""
        lo, hi = 0.0, 1.0
        ends = at([lo, hi])
        if fits(ends[lo if rising else hi]):
            return lo if rising else hi
        if not fits(ends[hi if rising else lo]):
            return hi if rising else lo
        for _ in range(HALVINGS // LEVELS):
            step = (hi - lo) / 2**LEVELS
            grid = [lo + k * step for k in range(1, 2**LEVELS)]
            seen = at(grid)
            for _ in range(LEVELS):
                mid = (lo + hi) / 2
                if fits(seen[mid]) == rising:
                    hi = mid
                else:
                    lo = mid
        return hi if rising else lo

    found = []
    if max_repetition is not None:
        found.append(search(lambda x: x[0] <= max_repetition, True))
    if target_entropy is not None:
        found.append(search(lambda x: x[1] >= target_entropy, False))
    return max(found) if found else 1.0


def order_key(doc_id: Column, what: Column | str) -> Column:
    what = F.lit(what) if isinstance(what, str) else what.cast("string")
    return F.md5(F.concat_ws("|", F.lit(SEED), what, F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def part_of(key: Column, ranges: Column) -> Column:
    """The range of the hash that a key falls into."""
    return F.floor(F.conv(F.substring(key, 1, 6), 16, 10).cast("bigint") * ranges / (1 << 24))


def plan(docs: DataFrame, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(placements, budgets): every copy of every document with its epoch and block; and one row a source."""
    slim, _ = materialize(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), token_count(F.col("text").cast("string")).alias("tokens")),
        "mix",
    )
    totals, _ = materialize(slim.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")), "totals")
    a = bisect_exponent(totals, max_repetition, target_entropy) if not totals.isEmpty() else 1.0
    powered = totals.crossJoin(totals.agg(F.sum("tokens").alias("__all"), F.max("n_docs").alias("__most"))).withColumn("__q", F.pow(F.col("tokens") / F.col("__all"), F.lit(a)))
    weighted = powered.crossJoin(powered.agg(F.sum("__q").alias("__z"))).withColumn("weight", F.col("__q") / F.col("__z"))
    whole = weighted.agg(F.max(F.col("tokens") / F.col("weight")).alias("__budget")) if budget is None else weighted.agg(F.lit(float(budget)).alias("__budget"))
    budgets = (
        weighted.crossJoin(whole)  # one-row sides
        .withColumn("target", F.greatest(F.round(F.col("weight") * F.col("__budget"), 3).cast("bigint"), F.lit(1)))
        .withColumn("blocks", F.greatest(F.ceil(F.round(F.col("__budget"), 3) / block_tokens), F.lit(1)).cast("bigint"))
        .withColumn("epochs", F.ceil(F.col("target") / F.col("tokens")).cast("int"))
        .withColumn("ranges", F.greatest(F.ceil(F.col("__most") / 4_000), F.lit(256)).cast("bigint"))
        .select("source", F.col("tokens").alias("source_tokens"), "weight", "target", "blocks", "epochs", "ranges")
    )
    budgets, _ = materialize(budgets, "budgets")
    copies = slim.join(budgets, "source").select("*", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"))
    copies = copies.withColumn("key", order_key(F.col("doc_id"), F.col("epoch")))
    copies = copies.withColumn("part", part_of(F.col("key"), F.col("ranges")))
    sums = copies.groupBy("source", "epoch", "part").agg(F.sum("tokens").alias("n"))
    ahead = Window.partitionBy("source", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most `ranges` rows
    bases = sums.select("source", "epoch", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "epoch", "part").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        copies.withColumn("upto", F.sum("tokens").over(inner))
        .withColumn("place", F.row_number().over(inner))
        .join(bases, ["source", "epoch", "part"])
        .withColumn("start", F.col("epoch") * F.col("source_tokens") + F.col("base") + F.col("upto") - F.col("tokens"))
        .where(F.col("start") < F.col("target"))
        .withColumn("block_id", F.floor(F.col("start") * F.col("blocks") / F.col("target")).cast("bigint"))
        .select("doc_id", "source", "tokens", "epoch", "key", "part", "place", "block_id")
    )
    return placed, budgets


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, tokens, epoch, block_id, block_pos (from 0): the whole mixture, without texts."""
    placed, _ = plan(docs, **how)
    inside = Window.partitionBy("block_id").orderBy(order_key(F.col("doc_id"), F.concat_ws("|", F.lit("b"), F.col("epoch").cast("string"))), "source", "doc_id", "epoch", "tokens")
    return placed.select("doc_id", "source", "tokens", "epoch", "block_id", (F.row_number().over(inside) - 1).cast("bigint").alias("block_pos"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The pipeline's form: each document as often as the mixture holds it, in the columns of ``documents``.

    Whole epochs take every document; the last, partial one takes those up to a cut in its permutation.
    One cut a source says it all, so texts are never shuffled - save those of rows that tie with the cut in
    source, id and tokens when the mixture holds only some of them: they are counted off."""
    placed, budgets = plan(docs, **how)
    least = F.lit(-(2**63))
    row = lambda key: F.struct(key.alias("key"), F.coalesce(F.col("doc_id").cast("bigint"), least).alias("id"), F.col("tokens").alias("tokens"))
    last = placed.join(budgets.select("source", "epochs"), "source").where(F.col("epoch") == F.col("epochs") - 1)
    top = F.max(F.struct(row(F.col("key")).alias("cut"), F.col("place"), F.col("part"))).alias("top")
    cuts, _ = materialize(budgets.select("source", "epochs", "ranges").join(last.groupBy("source").agg(top), "source", "left").select("source", "epochs", "ranges", "top.*"), "cuts")
    # Of the rows that equal the cut, the first ``taken`` are in: the last one placed stands at ``place`` of its part.
    slim = docs.select(F.col("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), token_count(F.col("text").cast("string")).alias("tokens"))
    at = slim.join(cuts, "source").withColumn("own", row(order_key(F.col("doc_id"), F.col("epochs") - 1)))
    same_part = part_of(F.col("own.key"), F.col("ranges")) == F.col("part")
    ties = at.groupBy("source").agg(F.sum((same_part & (F.col("own") < F.col("cut"))).cast("bigint")).alias("before"), F.sum((F.col("own") == F.col("cut")).cast("bigint")).alias("equal"))
    per, _ = materialize(cuts.join(ties, "source", "left").withColumn("taken", F.col("place") - F.col("before")), "ties")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    keyed = docs.select(*columns, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__s"), token_count(F.col("text").cast("string")).alias("tokens"))
    keyed = keyed.join(per.withColumnRenamed("source", "__s"), "__s").withColumn("own", row(order_key(F.col("doc_id"), F.col("epochs") - 1)))
    copies = lambda extra: F.explode(F.array_repeat(F.lit(0), (F.col("epochs") - 1 + extra).cast("int"))).alias("__copy")
    split = F.coalesce((F.col("own") == F.col("cut")) & (F.col("taken") < F.col("equal")), F.lit(False))
    out = keyed.where(~split).select(*columns, copies(F.coalesce((F.col("own") <= F.col("cut")).cast("int"), F.lit(0))))
    if not per.where("taken < equal").isEmpty():
        # Counted off per scan partition, then over the partitions, so that many equal rows are in no one task.
        some = keyed.where(split).withColumn("__p", F.spark_partition_id())
        some, _ = materialize(some.select(*columns, "__s", "__p", "epochs", "taken"), "tied")
        sizes = some.groupBy("__s", "__p").agg(F.count("*").alias("n"))
        ahead = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a scan partition
        bases = sizes.select("__s", "__p", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
        order = Window.partitionBy("__s", "__p").orderBy(F.xxhash64(*columns))
        counted = some.withColumn("__r", F.row_number().over(order)).join(bases, ["__s", "__p"])
        out = out.unionByName(counted.select(*columns, copies((F.col("base") + F.col("__r") <= F.col("taken")).cast("int"))))
    return out.drop("__copy")


MIX_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source,
         greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1) AS tokens
  FROM documents),
t AS (SELECT source, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY source),
ext AS (SELECT min(tokens) AS lo, max(tokens) AS hi, sum(tokens) AS total FROM t),
b(step, lo, hi) AS (
  SELECT 0, 0::DOUBLE, CASE WHEN (SELECT pow(hi / lo, 1.0) FROM ext) <= 2.0 THEN 0::DOUBLE ELSE 1::DOUBLE END
  UNION ALL
  SELECT step + 1,
         CASE WHEN pow(ext.hi / ext.lo, 1 - (b.lo + b.hi) / 2) <= 2.0 THEN b.lo ELSE (b.lo + b.hi) / 2 END,
         CASE WHEN pow(ext.hi / ext.lo, 1 - (b.lo + b.hi) / 2) <= 2.0 THEN (b.lo + b.hi) / 2 ELSE b.hi END
  FROM b, ext WHERE step < 30),
a AS (SELECT hi AS a FROM b WHERE step = 30),
q AS (SELECT source, tokens, pow(tokens / total, a) AS q FROM t, ext, a),
w AS (SELECT source, tokens, q / (SELECT sum(q) FROM q) AS weight FROM q),
bud AS (SELECT max(tokens / weight) AS budget FROM w),
s AS (
  SELECT source, tokens::BIGINT AS source_tokens,
         greatest(floor(round(weight * budget, 3))::BIGINT, 1) AS target,
         greatest(ceil(round(budget, 3) / 65536), 1)::BIGINT AS blocks,
         ceil(greatest(floor(round(weight * budget, 3))::BIGINT, 1) / tokens)::BIGINT AS epochs
  FROM w, bud),
c AS (
  SELECT d.doc_id, d.source, d.tokens, s.source_tokens, s.target, s.blocks, e.epoch,
         md5('mix|' || e.epoch || '|' || coalesce(d.doc_id::VARCHAR, '')) AS k
  FROM d JOIN s USING (source), LATERAL (SELECT unnest(range(s.epochs)) AS epoch) e),
p AS (
  SELECT *, epoch * source_tokens
         + sum(tokens) OVER (PARTITION BY source, epoch ORDER BY k, doc_id, tokens ROWS UNBOUNDED PRECEDING) - tokens AS start
  FROM c),
f AS (SELECT *, floor(start * blocks / target)::BIGINT AS block_id FROM p WHERE start < target)
SELECT doc_id, source, tokens::BIGINT AS tokens, epoch::INTEGER AS epoch, block_id,
       row_number() OVER (PARTITION BY block_id ORDER BY md5('mix|b|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')), source, doc_id, epoch, tokens) - 1 AS block_pos
FROM f
"""
