"""Lexical retrieval: BM25 with a title boost and character n-gram cosine, over postings tables.

An index is a table (term, article_id, weight), to be written once partitioned by term and joined by the
terms of the queries (:func:`siftwell.sources.sinks.save_index`); one-shot scoring builds only what given
queries need. n-grams are counted inside an article's own row, so postings are never shuffled to be counted:
they travel as 64-bit hashes, on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators.graph import ensure_checkpoints
from siftwell.operators.rank import few

Tokenize = Callable[[str], Column]
BROADCAST_TERMS = 500_000
BROADCAST_GRAMS = 2_000_000
PIECE = 1 << 20  # characters whose n-grams are counted at once
_MIX = 0x9E3779B97F4A7C15


def query_terms(queries: DataFrame, tokenize: Tokenize = T.tokens) -> DataFrame:
    """(query_id, term, qtf)."""
    return queries.select("query_id", F.explode(tokenize("query_text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def weighted_terms(corpus: DataFrame, title_weight: float = 2.0, tokenize: Tokenize = T.tokens, wanted: DataFrame | None = None) -> DataFrame:
    """(article_id, term, tf): occurrences in the text plus ``title_weight`` times those in the title."""
    both = F.concat(
        F.transform(tokenize("clean_text"), lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("w"))),
        F.transform(tokenize("title"), lambda t: F.struct(t.alias("term"), F.lit(float(title_weight)).alias("w"))),
    )
    rows = corpus.select("article_id", F.explode(both).alias("x")).select("article_id", "x.term", "x.w")
    if wanted is not None:
        rows = rows.join(few(wanted, BROADCAST_TERMS), "term", "left_semi")
    return rows.groupBy("article_id", "term").agg(F.sum("w").alias("tf"))


def lengths(corpus: DataFrame, title_weight: float = 2.0, tokenize: Tokenize = T.tokens) -> DataFrame:
    """(article_id, dl): weighted length, empty articles included."""
    return corpus.select("article_id", (F.size(tokenize("clean_text")) + title_weight * F.size(tokenize("title"))).cast("double").alias("dl"))


def bm25_postings(corpus: DataFrame, k1: float = 1.5, b: float = 0.75, title_weight: float = 2.0, tokenize: Tokenize = T.tokens, wanted: DataFrame | None = None) -> DataFrame:
    """(term, article_id, weight): idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))."""
    dl = lengths(corpus, title_weight, tokenize)
    totals = dl.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).select("n", F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0).alias("avgdl"))
    tf = weighted_terms(corpus, title_weight, tokenize, wanted)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    if wanted is not None:
        df = few(df, BROADCAST_TERMS)  # a word that every article has would put its postings into one task
    full = tf.join(df, "term").join(dl, "article_id").crossJoin(F.broadcast(totals))  # totals is one row
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = 1 - b + b * F.col("dl") / F.col("avgdl")
    return full.select("term", "article_id", (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)).alias("weight"))


def score_postings(terms: DataFrame, postings: DataFrame, weight: str = "weight", query_weight: str = "qtf", key: str = "term") -> DataFrame:
    """(query_id, article_id, score): sum over shared terms; pairs without one are absent (score 0)."""
    joined = postings.join(few(terms, BROADCAST_TERMS), key)
    return joined.groupBy("query_id", "article_id").agg(F.sum(F.col(query_weight) * F.col(weight)).alias("score"))


def bm25_scores(corpus: DataFrame, queries: DataFrame, **how) -> DataFrame:
    """BM25 of every pair with a shared term; only terms of the queries are ever shuffled."""
    terms = query_terms(queries, how.get("tokenize", T.tokens))
    return score_postings(terms, bm25_postings(corpus, wanted=terms.select("term").distinct(), **how))


def _weighed(column: str, weight: float) -> Column:
    return F.transform(T.blank_words(F.lower(F.coalesce(F.col(column), F.lit("")))), lambda x: F.struct(x.alias("word"), F.lit(float(weight)).alias("w")))


def gram_counts(texts: DataFrame, parts: list[tuple[str, float]], keys: list[str], low: int = 3, high: int = 5) -> DataFrame:
    """(keys..., gram, cnt): n-grams of each text part times its weight. Words are counted before they
    are cut, so a repeated word costs one cut."""
    words = [_weighed(c, w) for c, w in parts]
    counted = texts.select(*keys, F.explode(F.concat(*words)).alias("x")).select(*keys, "x.word", "x.w").groupBy(*keys, "word").agg(F.sum("w").alias("w"))
    grams = counted.select(*keys, "w", F.explode(T.word_ngrams(F.col("word"), low, high)).alias("gram"))
    return grams.groupBy(*keys, "gram").agg(F.sum("w").alias("cnt"))


def gram_table(texts: DataFrame, parts: list[tuple[str, float]], key: str, low: int = 3, high: int = 5) -> DataFrame:
    """(gram, df, cnt): rows that have the n-gram and its weighted count over all rows. Counted inside the rows, then
    in each task, then in one shuffle of distinct grams. Rows that repeat a key take :func:`gram_counts`, as their
    texts count together."""
    if not texts.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return gram_counts(texts, parts, [key], low, high).groupBy("gram").agg(F.count("*").alias("df"), F.sum("cnt").alias("cnt"))
    words = [F.array_join(T.blank_words(F.lower(F.coalesce(F.col(c), F.lit("")))), " ").alias(f"__{i}") for i, (c, _) in enumerate(parts)]
    weights = [w for _, w in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[int, int] = {}  # hash -> where the gram stands in the columns below
        grams: list[str] = []
        df, cnt = np.zeros(1 << 16, np.int64), np.zeros(1 << 16)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(weights)))):
                own: list[np.ndarray] = []
                for text, weight in zip(row, weights):
                    for piece in _pieces(text):
                        padded = f" {piece} "
                        for n, hashes, starts in _gram_steps(piece, low, high):
                            keys, first, times = np.unique(hashes, return_index=True, return_counts=True)
                            at = np.empty(len(keys), np.int64)
                            for k, h in enumerate(keys.tolist()):
                                if (where := place.get(h, -1)) < 0:
                                    where = place[h] = len(grams)
                                    grams.append(padded[starts[first[k]] : starts[first[k]] + n])
                                at[k] = where
                            if len(grams) > len(df):
                                df, cnt = (np.concatenate([x, np.zeros(max(len(x), len(grams)), x.dtype)]) for x in (df, cnt))
                            cnt[at] += weight * times
                            own.append(at)
                if own:
                    df[np.unique(np.concatenate(own))] += 1
        for lo in range(0, len(grams), 1 << 16):
            hi = min(lo + (1 << 16), len(grams))
            yield pa.RecordBatch.from_arrays([pa.array(grams[lo:hi], pa.string()), pa.array(df[lo:hi]), pa.array(cnt[lo:hi])], names=["gram", "df", "cnt"])

    made = texts.select(*words).mapInArrow(run, "gram string, df bigint, cnt double")
    return made.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("cnt").alias("cnt"))


def _gram_steps(text: str, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By length n: the hashes of the n-grams of each word between two blanks, and where they start in the text
    between two blanks; ``text``: words joined by single blanks."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blanks = np.r_[0, np.cumsum(c == 32)]
    h = c
    for n in range(2, high + 1):
        if len(h) < 2:
            break
        h = h[:-1] * np.uint64(_MIX) + c[n - 1 :]
        if n >= low:  # a blank may open or close an n-gram, not stand inside
            at = np.flatnonzero(blanks[n - 1 : len(h) + n - 1] == blanks[1 : len(h) + 1])
            g = h[at] ^ np.uint64(n)
            g ^= g >> np.uint64(29)
            g *= np.uint64(0xBF58476D1CE4E5B9)
            yield n, (g ^ (g >> np.uint64(32))).view(np.int64), at


def gram_hashes(text: str, low: int, high: int) -> np.ndarray:
    """64-bit hashes of the n-grams of each word between two blanks; ``text``: words joined by single blanks."""
    return np.concatenate([np.zeros(0, np.int64), *(g for _, g, _ in _gram_steps(text, low, high))])


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.find(" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end + 1


def count_grams(parts: list[tuple[str, float]], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, weighted counts) over (text, weight) parts; long texts piece by piece."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0)
    for text, weight in parts:
        for piece in _pieces(text):
            new = gram_hashes(piece, low, high)
            both, w = np.concatenate([keys, new]), np.concatenate([counts, np.full(len(new), weight)])
            keys, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, weights=w, minlength=len(keys))
    return keys, counts


def hashed_grams(texts: DataFrame, parts: list[tuple[str, float]], key: str, low: int = 3, high: int = 5, rows: int = 256) -> DataFrame:
    """(key, gram, cnt): hashed n-grams of each row's text parts times their weights, one row a gram of a row;
    ``key`` is unique. Nothing is shuffled."""
    words = [F.array_join(T.blank_words(F.lower(F.coalesce(F.col(c), F.lit("")))), " ").alias(f"__{i}") for i, (c, _) in enumerate(parts)]
    weights = [w for _, w in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                found = [count_grams([(t, w) for t, w in zip(texts, weights) if t], low, high) for texts in zip(*(part.column(i + 1).to_pylist() for i in range(len(weights))))]
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(k) for k, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([k for k, _ in found]), pa.int64()), pa.array(np.concatenate([c for _, c in found]), pa.float64())], names=[key, "gram", "cnt"])

    return texts.select(F.col(key).cast("bigint").alias(key), *words).mapInArrow(run, f"`{key}` bigint, gram bigint, cnt double")


def _tf(sublinear: bool) -> Column:
    return 1 + F.ln("cnt") if sublinear else F.col("cnt")


def chargram_idf(counts: DataFrame, corpus: DataFrame, min_df: int = 2) -> DataFrame:
    """(gram, df, idf) of grams in ``min_df`` articles at least: partial counts, one shuffle of distinct grams."""
    n = corpus.agg(F.count("*").alias("n"))
    df = counts.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return df.crossJoin(F.broadcast(n)).select("gram", "df", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # n is one row


def _weighed_grams(counts: DataFrame, idf: DataFrame, sublinear: bool, keep: Column) -> DataFrame:
    """(article_id, norm, hits): the length of each article's vector and its (gram, w) where ``keep``."""
    raw = counts.join(few(idf, BROADCAST_GRAMS), "gram").withColumn("w", _tf(sublinear) * F.col("idf"))
    hits = F.collect_list(F.when(keep, F.struct("gram", "w")))
    return raw.groupBy("article_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), hits.alias("hits"))


def _as_postings(weighed: DataFrame) -> DataFrame:
    unit = F.when(F.col("norm") > 0, F.col("h.w") / F.col("norm")).otherwise(0.0)
    return weighed.select("article_id", "norm", F.explode("hits").alias("h")).select("h.gram", "article_id", unit.alias("weight"))


def chargram_index(corpus: DataFrame, low: int = 3, high: int = 5, min_df: int = 2, sublinear: bool = True, title_weight: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(postings (gram, article_id, weight), idf (gram, df, idf)) with hashed grams; rows have unit length over
    the vocabulary. To be saved once and scored against any queries by :func:`chargram_scores_from`."""
    counts = hashed_grams(corpus, [("clean_text", 1.0), ("title", title_weight)], "article_id", low, high)
    ensure_checkpoints(corpus.sparkSession)
    idf = chargram_idf(counts, corpus, min_df).checkpoint()
    return _as_postings(_weighed_grams(counts, idf, sublinear, F.lit(True))), idf


def chargram_queries(queries: DataFrame, idf: DataFrame, low: int = 3, high: int = 5, sublinear: bool = True) -> DataFrame:
    """(query_id, gram, qw): unit query vectors over the vocabulary."""
    counts = hashed_grams(queries, [("query_text", 1.0)], "query_id", low, high)
    raw = idf.join(few(counts, BROADCAST_TERMS), "gram").select("query_id", "gram", (_tf(sublinear) * F.col("idf")).alias("w"))
    norms = raw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "query_id").select("query_id", "gram", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(0.0).alias("qw"))


def chargram_scores_from(postings: DataFrame, idf: DataFrame, queries: DataFrame, low: int = 3, high: int = 5, sublinear: bool = True) -> DataFrame:
    """Cosine of every pair with a shared gram, from an index made before."""
    return score_postings(chargram_queries(queries, idf, low, high, sublinear), postings, query_weight="qw", key="gram")


def chargram_scores(corpus: DataFrame, queries: DataFrame, low: int = 3, high: int = 5, min_df: int = 2, sublinear: bool = True, title_weight: float = 2.0) -> DataFrame:
    """Cosine of every pair with a shared gram. All grams of an article count in its norm, inside its row; only
    those of the queries leave it."""
    ensure_checkpoints(corpus.sparkSession)
    counts = hashed_grams(corpus, [("clean_text", 1.0), ("title", title_weight)], "article_id", low, high)
    idf = chargram_idf(counts, corpus, min_df).checkpoint()
    terms = chargram_queries(queries, idf, low, high, sublinear).checkpoint()
    asked = terms.select("gram").distinct().withColumn("asked", F.lit(True))
    flagged = idf.join(few(asked, BROADCAST_TERMS), "gram", "left")
    return score_postings(terms, _as_postings(_weighed_grams(counts, flagged, sublinear, F.col("asked"))), query_weight="qw", key="gram")
