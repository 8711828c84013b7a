"""Scores of a stated query set against all articles, an article's in one row.

Both lexical scores of a pair follow from the article's own row, the queries and one frequency a term or gram.
So the articles are read twice: once to count frequencies (partial counts, one shuffle of distinct grams), once
to score. What is small travels with the tasks (the queries' terms and grams, the frequencies); no posting and
no pair is shuffled or joined, and a row is (article_id, one array of scores a source, in the order of the
queries; 0 where the pair is not listed, as every listed pair scores more than 0).

:func:`build` gives None where that does not hold: too many queries or grams, null ids, or ids repeated beyond
what :func:`merged` takes. The joins of :mod:`siftwell.operators.lexical` serve there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import lexical, rank
from siftwell.operators.graph import ensure_checkpoints

SOURCES = ("bm25", "char")
MOST_QUERIES = 4096
MATRIX_BYTES = 64 << 20  # of a source's terms by queries
DOCS = 64  # articles whose scores are made in one matrix product
ARROW_ROWS = 256
PENDING = 1 << 19  # grams held until they are counted together
MOST_CHARS = 16 << 20  # of all rows of a repeated id, which are gathered in one row
CLOSE = 2e-6  # scores further apart never swap by rounding to six decimals
_GOLD = np.uint64(0x9E3779B97F4A7C15)

Columns = dict[str, tuple[object, pa.DataType]]


class Places:
    """Where each of distinct 64-bit keys stands in the given array; -1 for others (open addressing)."""

    def __init__(self, keys: np.ndarray):
        bits = max(10, len(keys).bit_length() + 2)
        self.keys, self.shift, self.mask = keys, np.uint64(64 - bits), (1 << bits) - 1
        self.at = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._home(keys)
        while len(left):
            here = slot[left]
            free = self.at[here] < 0
            self.at[here[free]] = left[free]
            left = left[self.at[here] != left]
            slot[left] = (slot[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _GOLD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        todo, slot = np.arange(len(keys)), self._home(keys)
        while len(todo) and len(self.keys):
            at = self.at[slot]
            same = (at >= 0) & (self.keys[at] == keys[todo])
            out[todo[same]] = at[same]
            on = (at >= 0) & ~same
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each came."""
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.diff(np.r_[first, len(keys)])


def grams_of(body: str, title: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of an article's n-grams; the title counts twice."""
    if len(body) > lexical.PIECE or len(title) > lexical.PIECE:
        return lexical.count_grams([(t, w) for t, w in ((body, 1.0), (title, 2.0)) if t], 3, 5)
    head = lexical.gram_hashes(title, 3, 5) if title else np.zeros(0, np.int64)
    return runs(np.concatenate([lexical.gram_hashes(body, 3, 5) if body else np.zeros(0, np.int64), head, head]))


def merged(corpus: DataFrame, counts: DataFrame) -> DataFrame:
    """The corpus with the rows of a repeated id in one, and their ``lengths`` as :func:`lexical.lengths` has them:
    terms and n-grams never span a blank, so texts joined by blanks have the terms and n-grams of all rows. Only
    repeated rows are shuffled, once a reading. ``counts``: (article_id, n)."""
    sized = corpus.select("article_id", "title", "clean_text", (F.size(T.tokens("clean_text")) + 2.0 * F.size(T.tokens("title"))).cast("double").alias("dl"))
    together = lambda c: F.array_join(F.filter(F.collect_list(c), lambda t: t != ""), " ").alias(c)
    ids = counts.where("n > 1").select("article_id")
    if ids.limit(rank.BROADCAST_GROUPS + 1).count() > rank.BROADCAST_GROUPS:
        return sized.groupBy("article_id").agg(together("title"), together("clean_text"), F.collect_list("dl").alias("lengths"))
    again = sized.join(F.broadcast(ids), "article_id", "left_semi").groupBy("article_id").agg(together("title"), together("clean_text"), F.collect_list("dl").alias("lengths"))
    once = sized.join(F.broadcast(ids), "article_id", "left_anti")
    return once.select("article_id", "title", "clean_text", F.array("dl").alias("lengths")).unionByName(again)


def _inputs(corpus: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """(article_id, then text and title as tokens for bm25 and as words for char, joined by blanks; the white
    space of a corpus is folded already; then the ``lengths`` of a merged one)."""
    words = {"bm25": lambda c: F.array_join(T.tokens(c), " "), "char": lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))}
    return corpus.select("article_id", *[words[s](c).alias(f"{s}_{c}") for s in sources for c in ("clean_text", "title")], *[c for c in ("lengths",) if c in corpus.columns])


def _texts(batch: pa.RecordBatch, sources: tuple[str, ...]) -> dict[str, list[tuple[str, str]]]:
    return {s: list(zip(batch.column(f"{s}_clean_text").to_pylist(), batch.column(f"{s}_title").to_pylist())) for s in sources}


def _term_counts(body: str, title: str) -> tuple[Counter, float]:
    """Occurrences by term and the length; the title counts twice."""
    a, b = body.split(" ") if body else [], title.split(" ") if title else []
    counts = Counter(a)
    for w in b:
        counts[w] += 2
    return counts, len(a) + 2.0 * len(b)


def frequencies(corpus: DataFrame, sources: tuple[str, ...], terms: list[str]) -> DataFrame:
    """(kind, key, n, x): kind 0, the number of articles and their total length; kind 1, articles by place of
    the term in ``terms``; kind 2, articles by gram. Counted in each task, then in one shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {t: i for i, t in enumerate(terms)}
        df, docs, length = np.zeros(len(terms), np.int64), 0, 0.0
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        pending = 0

        def settle() -> None:
            nonlocal keys, counts, held, pending
            new, n = runs(np.concatenate(held)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            both, c = np.concatenate([keys, new]), np.concatenate([counts, n])
            order = np.argsort(both, kind="stable")
            both, c = both[order], c[order]
            first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
            keys, counts = both[first], np.add.reduceat(c, first) if len(both) else c
            held, pending = [], 0

        for batch in batches:
            found = _texts(batch, sources)
            docs += len(batch.column("lengths").flatten()) if "lengths" in batch.schema.names else batch.num_rows
            for body, title in found.get("bm25", ()):
                words, size = _term_counts(body, title)
                length += size
                for w in words.keys() & index.keys():
                    df[index[w]] += 1
            for body, title in found.get("char", ()):
                mine, _ = grams_of(body, title)
                held.append(mine)
                pending += len(mine)
                if pending > max(PENDING, len(keys)):
                    settle()
        settle()
        kind = np.r_[0, np.full(len(df), 1), np.full(len(keys), 2)].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind), pa.array(np.r_[0, np.arange(len(df)), keys].astype(np.int64)), pa.array(np.r_[docs, df, counts].astype(np.int64)), pa.array(np.r_[length, np.zeros(len(df) + len(keys))])],
            names=["kind", "key", "n", "x"],
        )

    made = _inputs(corpus, sources).mapInArrow(run, "kind int, key bigint, n bigint, x double")
    return made.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))


@dataclass(frozen=True)
class Board:
    """``table``: (article_id, an array<double> a source) over the queries ``ids``."""

    table: DataFrame
    ids: np.ndarray
    sources: tuple[str, ...]
    n_articles: int

    def kept(self) -> Board:
        """The same board written to the checkpoint folder: it is read more than once."""
        ensure_checkpoints(self.table.sparkSession)
        return replace(self, table=self.table.checkpoint())

    def rows(self, make: Callable[[dict[str, np.ndarray], object], Iterator[tuple[np.ndarray, Columns]]], schema: str, fresh: Callable[[], object] = object) -> DataFrame:
        """(query_id, article_id, more): for the articles by queries matrices of all sources ``make`` gives tables:
        which pairs come out, and the further columns (matrices, or one value for all).
        ``fresh`` makes the state that ``make`` gets, one a task."""
        ids, sources = self.ids, self.sources

        def column(v, kind: pa.DataType, d: np.ndarray, q: np.ndarray) -> pa.Array:
            return pa.array(v[d, q], kind) if isinstance(v, np.ndarray) else pa.array([v], kind).take(pa.array(np.zeros(len(d), np.int64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = fresh()
            for batch in batches:
                for lo in range(0, batch.num_rows, DOCS):
                    part = batch.slice(lo, DOCS)
                    scores = {s: part.column(s).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(ids)) for s in sources}
                    articles = part.column("article_id").to_numpy(zero_copy_only=False)
                    for listed, cols in make(scores, state):
                        d, q = np.nonzero(listed)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(articles[d]), *[column(v, kind, d, q) for v, kind in cols.values()]], names=["query_id", "article_id", *cols])

        return self.table.mapInArrow(run, f"query_id bigint, article_id bigint, {schema}")

    def single(self, value: Callable[[dict[str, np.ndarray]], np.ndarray], source: str | None = None) -> DataFrame:
        """(query_id, article_id, score): ``value`` of the pairs that ``source`` (default: any source) lists."""

        def make(s: dict[str, np.ndarray], _: object):
            yield any_listed(s if source is None else {source: s[source]}), {"score": (value(s), pa.float64())}

        return self.rows(make, "score double")

    def long(self, source: str) -> DataFrame:
        """(query_id, article_id, score) of the source's listed pairs."""
        return self.single(lambda s: s[source], source)

    def by_query(self) -> DataFrame:
        """(query_id, article_id, a column a source): pairs that any source lists, null where one does not, dealt
        by query. Many pairs of a query travel in one row, which takes half the bytes of a row each."""
        ids, sources = self.ids, self.sources

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                scores = [batch.column(s).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(ids)).T for s in sources]
                listed = np.logical_or.reduce([x > 0 for x in scores])
                q, d = np.nonzero(listed)
                ends = pa.array(np.r_[0, np.cumsum(listed.sum(axis=1))].astype(np.int32))
                values = [batch.column("article_id").to_numpy(zero_copy_only=False)[d], *(x[q, d] for x in scores)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.ListArray.from_arrays(ends, pa.array(v)) for v in values)], names=["query_id", "article_id", *sources])

        packed = self.table.mapInArrow(run, "query_id bigint, article_id array<bigint>, " + ", ".join(f"{s} array<double>" for s in sources))
        # Few queries a task: their pairs are sorted in memory.
        rows = packed.repartition(min(len(ids), 2048), "query_id").select("query_id", F.inline(F.arrays_zip("article_id", *sources)))
        return rows.select("query_id", "article_id", *[F.nullif(F.col(s), F.lit(0.0)).alias(s) for s in sources])

    def tagged(self, value: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], out: str) -> DataFrame:
        """(query_id, article_id, source, out): ``value``, a matrix a source, of each source's listed pairs."""
        names = self.sources

        def make(s: dict[str, np.ndarray], _: object):
            v = value(s)
            for n in names:
                yield s[n] > 0, {"source": (n, pa.string()), out: (v[n], pa.float64())}

        return self.rows(make, f"source string, {out} double")

    def stats(self) -> dict[str, dict[str, np.ndarray]]:
        """By source, an entry a query: n, lo, hi, mean and sd of the listed scores. Partial sums of each task,
        then a row a source and query."""
        sources, q = self.sources, len(self.ids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s1, m2 = (np.zeros((len(sources), q)) for _ in range(3))
            lo, hi = np.full((len(sources), q), np.inf), np.zeros((len(sources), q))
            for batch in batches:
                if not batch.num_rows:
                    continue
                for k, name in enumerate(sources):
                    x = batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, q)
                    has = x > 0
                    c, t = has.sum(axis=0), x.sum(axis=0)
                    mean = t / np.maximum(c, 1)
                    m = (np.where(has, x - mean, 0.0) ** 2).sum(axis=0)
                    gap = np.where((c > 0) & (n[k] > 0), s1[k] / np.maximum(n[k], 1) - mean, 0.0)
                    m2[k] += m + gap * gap * n[k] * c / np.maximum(n[k] + c, 1)
                    n[k] += c
                    s1[k] += t
                    lo[k], hi[k] = np.minimum(lo[k], np.where(has, x, np.inf).min(axis=0)), np.maximum(hi[k], x.max(axis=0))
            at = np.arange(len(sources) * q)
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(v.ravel()) for v in (n, lo, hi, s1, m2))], names=["at", "n", "lo", "hi", "s1", "m2"])

        made = self.table.mapInArrow(run, "at bigint, n double, lo double, hi double, s1 double, m2 double").where("n > 0")
        found = made.groupBy("at").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("s1").alias("s1"), F.sum("m2").alias("m2"), F.sum(F.col("s1") * F.col("s1") / F.col("n")).alias("b")).collect()
        out = {s: {k: np.zeros(q) for k in ("n", "lo", "hi", "mean", "sd")} for s in sources}
        for r in found:  # a row a source and query
            own, i = out[sources[r["at"] // q]], r["at"] % q
            mean = r["s1"] / r["n"]
            for k, v in (("n", r["n"]), ("lo", r["lo"]), ("hi", r["hi"]), ("mean", mean), ("sd", max(0.0, (r["m2"] + r["b"] - r["s1"] * mean) / r["n"]) ** 0.5)):
                own[k][i] = v
        return out

    def norms(self) -> Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]:
        """Min-max of every source by query as in :func:`rank.minmax`: pairs that are not listed score 0."""
        found = self.stats()
        low, span = {}, {}
        for s, v in found.items():
            low[s] = np.where(v["n"] < self.n_articles, np.minimum(v["lo"], 0.0), v["lo"])
            span[s] = np.where(v["n"] < self.n_articles, np.maximum(v["hi"], 0.0), v["hi"]) - low[s]

        def norm(scores: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            return {s: np.where((x > 0) & (span[s] > 0), (x - low[s]) / np.where(span[s] > 0, span[s], 1.0), 0.0) for s, x in scores.items()}

        return norm

    def weighted(self, weights: dict[str, float], norm=None) -> DataFrame:
        """(query_id, article_id, score): the weighted sum of min-max scores, of every listed pair."""
        norm = norm or self.norms()
        return self.single(lambda s: combined(norm(s), weights))

    def replaced(self, base: str, folded: np.ndarray, weights: dict[str, float], norm=None) -> DataFrame:
        """(query_id, article_id, score): scores of ``base``, for the queries ``folded`` the weighted min-max scores
        of every listed pair, as :func:`fusion.replace_out_of_fold` has them; one reading, no join of pairs."""
        norm = norm or self.norms()
        asked = np.isin(self.ids, folded)

        def make(s: dict[str, np.ndarray], _: object):
            yield np.where(asked, any_listed(s), s[base] > 0), {"score": (np.where(asked, combined(norm(s), weights), s[base]), pa.float64())}

        return self.rows(make, "score double")

    def best(self, k: int, weights: list[dict[str, float]], norm=None, only: np.ndarray | None = None) -> DataFrame:
        """(query_id, article_id, wid, score): what can be among the k first by any of the weights (min-max scores,
        or raw scores of the listed pairs without ``norm``): pairs that k others of their task beat by more than
        rounding hides do not leave it. ``only``: the queries in question."""
        q = len(self.ids)
        asked = np.ones(q, bool) if only is None else np.isin(self.ids, only)

        def make(s: dict[str, np.ndarray], top: list[np.ndarray]):
            v = norm(s) if norm else s
            listed = any_listed(s if norm else {n: s[n] for n in weights[0]}) & asked
            for wid, w in enumerate(weights):
                score = combined(v, w)
                own = np.where(listed, score, -np.inf)
                yield listed & (score >= top[wid].min(axis=0) - CLOSE), {"wid": (wid, pa.int32()), "score": (score, pa.float64())}
                both = np.concatenate([top[wid], own])
                top[wid] = np.partition(both, len(both) - k, axis=0)[-k:]

        return self.rows(make, "wid int, score double", fresh=lambda: [np.full((k, q), -np.inf) for _ in weights])

    def top(self, k: int, weights: dict[str, float], norm=None) -> DataFrame:
        """The k first of each query by one weighting, with ``rank``."""
        return rank.top_k(self.best(k, [weights], norm).drop("wid"), k)

    def features(self) -> DataFrame:
        """(query_id, article_id, <source>_norm, <source>_rr ...) as in :func:`fusion.features`: pairs meet once, by
        query, and all windows share that exchange."""
        by = Window.partitionBy("query_id")
        cols = []
        for s in self.sources:
            low, high, partial = F.min(s).over(by), F.max(s).over(by), F.count(s).over(by) < self.n_articles
            low, high = F.when(partial, F.least(low, F.lit(0.0))).otherwise(low), F.when(partial, F.greatest(high, F.lit(0.0))).otherwise(high)
            cols.append(F.coalesce((F.col(s) - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)).alias(f"{s}_norm"))
            cols.append(F.coalesce(self._reciprocal(s), F.lit(0.0)).alias(f"{s}_rr"))
        return self.by_query().select("query_id", "article_id", *cols)

    def _reciprocal(self, source: str) -> Column:
        order = Window.partitionBy("query_id").orderBy(F.round(F.col(source), rank.DIGITS).desc_nulls_last(), F.col("article_id").asc())
        return F.when(F.col(source).isNotNull(), 1.0 / F.row_number().over(order))

    def mean_reciprocal_rank(self) -> DataFrame:
        """(query_id, article_id, score): the mean, over the sources that list the pair, of its reciprocal ranks."""
        rrs = self.by_query().select("query_id", "article_id", *[self._reciprocal(s).alias(s) for s in self.sources])
        total, n = (sum((F.coalesce(c(F.col(s)), F.lit(0.0)) for s in self.sources), F.lit(0.0)) for c in (lambda x: x, lambda x: x.isNotNull().cast("double")))
        return rrs.select("query_id", "article_id", (total / n).alias("score"))

    def mean_zscore(self) -> DataFrame:
        """(query_id, article_id, score): the mean, over the sources that list the pair, of its z-scores."""
        found = self.stats()
        return self.single(lambda s: listed_mean({n: (x - found[n]["mean"]) / (found[n]["sd"] + 1e-6) for n, x in s.items()}, s))

    def subsets(self) -> DataFrame:
        """(subset, query_id, article_id, score): the raw mean of every non-empty subset of sources (a bit mask each)."""
        names = self.sources

        def make(s: dict[str, np.ndarray], _: object):
            for mask in range(1, 1 << len(names)):
                own = {n: s[n] for k, n in enumerate(names) if mask >> k & 1}
                yield any_listed(own), {"subset": (mask, pa.int64()), "score": (listed_mean(own, own), pa.float64())}

        return self.rows(make, "subset bigint, score double").select("subset", "query_id", "article_id", "score")

    def missing(self) -> DataFrame:
        """(source, missing) as in :func:`contracts.same_pairs`."""
        names = self.sources

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(names) + 1, np.int64)
            for batch in batches:
                has = [batch.column(s).flatten().to_numpy(zero_copy_only=False) > 0 for s in names]
                n += [h.sum() for h in (*has, np.logical_or.reduce(has))]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n[:-1]), pa.array(n[-1] - n[:-1])], names=["source", "own", "missing"])

        made = self.table.mapInArrow(run, "source string, own bigint, missing bigint")
        return made.groupBy("source").agg(F.sum("own").alias("own"), F.sum("missing").alias("missing")).where("own > 0").drop("own")


def combined(scores: dict[str, np.ndarray], weights: dict[str, float]) -> np.ndarray:
    return sum(w * scores[n] for n, w in weights.items())


def listed_mean(values: dict[str, np.ndarray], scores: dict[str, np.ndarray]) -> np.ndarray:
    """The mean of the values of the sources that list the pair."""
    n = sum((scores[s] > 0).astype(float) for s in values)
    return sum(np.where(scores[s] > 0, v, 0.0) for s, v in values.items()) / np.maximum(n, 1)


def any_listed(scores: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_or.reduce([x > 0 for x in scores.values()])


def build(corpus: DataFrame, queries: DataFrame, sources: tuple[str, ...] = SOURCES, min_df: int = 2, k1: float = 1.5, b: float = 0.75, repeats: bool = False) -> Board | None:
    """The board of :func:`lexical.bm25_scores` and :func:`lexical.chargram_scores` with their default settings.
    ``repeats``: rows that repeat an id count together (see :func:`merged`); all of them count as articles, and each
    adds a BM25 weight by its own length."""
    conf = corpus.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:  # whole texts go to Python
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    asked = queries.select("query_id").limit(MOST_QUERIES + 1).collect()
    if not asked or len(asked) > MOST_QUERIES or any(r.query_id is None for r in asked) or len({r.query_id for r in asked}) < len(asked):
        return None
    counts = corpus.groupBy("article_id").agg(F.count("*").alias("n"), F.sum(F.length("clean_text") + F.length("title")).alias("chars"))
    if not counts.where("n > 1 OR article_id IS NULL").isEmpty():
        if not repeats or not counts.where(f"article_id IS NULL OR (n > 1 AND chars > {MOST_CHARS})").isEmpty():
            return None
        corpus = merged(corpus, counts)
    ids = np.array(sorted(r.query_id for r in asked), np.int64)
    place = {int(q): i for i, q in enumerate(ids)}
    most = MATRIX_BYTES // 8 // len(ids)
    terms: dict[str, int] = {}
    told = lexical.query_terms(queries).collect() if "bm25" in sources else []  # words of few queries
    for r in told:
        terms.setdefault(r.term, len(terms))
    spoken = lexical.hashed_grams(queries, [("query_text", 1.0)], "query_id").collect() if "char" in sources else []
    grams = np.unique(np.array([r.gram for r in spoken], np.int64))
    if max(len(terms), len(grams)) > most:
        return None
    ensure_checkpoints(corpus.sparkSession)
    found = frequencies(corpus, sources, list(terms)).where(f"kind < 2 OR n >= {int(min_df)}").checkpoint()
    if found.limit(lexical.BROADCAST_GRAMS + len(terms) + 2).count() > lexical.BROADCAST_GRAMS + len(terms) + 1:
        return None
    # Columns, not rows: 12 bytes a gram that two articles share.
    got = {c: v.to_numpy() for c, v in zip(("kind", "key", "n", "x"), found.toArrow().combine_chunks().columns)}
    n, length = int(got["n"][got["kind"] == 0].sum()), float(got["x"][got["kind"] == 0].sum())
    avgdl = length / n if n and length > 0 else 1.0
    bm25 = np.zeros((len(terms), len(ids)))
    for r in told:
        bm25[terms[r.term], place[r.query_id]] += r.qtf
    df = np.zeros(len(terms))
    df[got["key"][got["kind"] == 1]] = got["n"][got["kind"] == 1]
    idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
    keys, count = got["key"][got["kind"] == 2].astype(np.int64), got["n"][got["kind"] == 2]
    gram_idf = np.log((1 + n) / (1 + count)) + 1
    known = Places(keys).find(grams) if len(grams) else np.zeros(0, np.int32)
    col = {int(g): i for i, g in enumerate(grams)}
    char = np.zeros((len(grams), len(ids)))
    for r in spoken:
        if known[col[r.gram]] >= 0:
            char[col[r.gram], place[r.query_id]] += (1 + np.log(r.cnt)) * gram_idf[known[col[r.gram]]]
    size = np.sqrt((char * char).sum(axis=0))
    char = np.divide(char, size, out=np.zeros_like(char), where=size > 0)
    column = np.full(len(keys), -1, np.int32)
    column[known[known >= 0]] = np.flatnonzero(known >= 0)
    names = list(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, places = {t: i for i, t in enumerate(names)}, Places(keys)
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS):
                part = batch.slice(lo, DOCS)
                texts, out = _texts(part, sources), []
                lengths = part.column("lengths").to_pylist() if "lengths" in part.schema.names else None
                for s in sources:
                    x = np.zeros((part.num_rows, len(names) if s == "bm25" else len(grams)))
                    for d, (body, title) in enumerate(texts[s]):
                        if s == "bm25":
                            words, dl = _term_counts(body, title)
                            at = [(index[w], words[w]) for w in words.keys() & index.keys()]
                            if at:
                                i, tf = np.array([a for a, _ in at]), np.array([float(c) for _, c in at])
                                for own in lengths[d] if lengths else (dl,):
                                    x[d, i] += idf[i] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * own / avgdl))
                        else:
                            mine, cnt = grams_of(body, title)
                            at = places.find(mine)
                            cnt, at = cnt[at >= 0], at[at >= 0]
                            w = (1 + np.log(cnt)) * gram_idf[at]
                            c = column[at]
                            x[d, c[c >= 0]] = w[c >= 0] / max(float(np.sqrt(w @ w)), 1e-300)
                    scores = x @ (bm25 if s == "bm25" else char)
                    out.append(pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * len(ids), pa.int32()), pa.array(scores.ravel())))
                yield pa.RecordBatch.from_arrays([part.column("article_id"), *out], names=["article_id", *sources])

    schema = "article_id bigint, " + ", ".join(f"{s} array<double>" for s in sources)
    return Board(_inputs(corpus, sources).mapInArrow(run, schema), ids, sources, n)
