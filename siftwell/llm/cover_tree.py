"""Exact top-k maximum inner product search with two cover trees at once.

Vectors become integers, floor(scale * x) by component, so scores are exact: products are summed in float64
where no sum can pass 2^53, in 64-bit integers where none can pass 2^63; beyond that an OverflowError tells.

The trees' top level is shared by all tasks: ``most_cells`` rows at most (least hash) are pivots, every row
belongs to the cell of its nearest pivot, and a cell's covering radius is its farthest row. Cells are cut into
blocks of about ``block_rows`` rows. Neighbouring cells' queries form groups of about ``group_rows``.

For nodes (cells, or nodes of the trees below) with centres q, p, radii r_q, r_p

    max <x, y>  <=  <q, p> + r_q |p| + r_p |q| + r_q r_p

(inside a task the covering radii's angles give a second bound, |x| |y| cos(angle between the centres, less
both); the smaller counts), and a pair is pruned when the bound is below the worst kth score among the query
node's own queries.

1. Every query searches one block of its own cell. That gives a first kth score of each query.
2. Pairs of cells whose bound is below the worst of the query cell's kth scores are dropped on the driver
   (``most_cells``^2 numbers at most); only the blocks of pairs that remain are sent to their query groups.
3. Each (group, block) is an independent task: cover trees over both are descended together, children with
   the best bound first, so that kth scores rise early; pairs of leaves are multiplied out.

The blocks' k best of every query then meet in a window that keeps k. How much is pruned depends on the data:
clustered vectors send few blocks, nearly isotropic ones all of them.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids; vectors of
different lengths raise a ValueError. Rows that repeat a vec_id and vector count once; different vectors under
one vec_id are rows of their own, as candidates, and a query of such an id takes its best scores over them;
rows with the query's own id are never its candidates. Ties go to the smaller vec_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import materialize

SCALE = 256
LEAF = 96
QUERY_LEAF = 24
SHRINK = 1.5
LOWEST = -(2**62)


class Node:
    """Rows ``idx`` of ``x`` within ``radius`` of ``centre`` and within ``angle`` of its direction, none
    longer than ``longest``; a leaf has no children."""

    __slots__ = ("centre", "norm", "radius", "idx", "children", "angle", "longest")

    def __init__(self, x: np.ndarray, centre: np.ndarray, radius: float, idx: np.ndarray, children: list[Node]):
        self.centre, self.norm, self.radius, self.idx, self.children = centre, float(np.sqrt(centre @ centre)), radius, idx, children
        norms = np.sqrt((x[idx] ** 2).sum(axis=1))
        self.longest = float(norms.max())
        if self.norm == 0 or norms.min() == 0:
            self.angle = np.pi
        else:
            self.angle = float(np.arccos(np.clip((x[idx] @ centre) / (norms * self.norm), -1, 1)).max())


def most(q: Node, p: Node) -> float:
    """No inner product of a row of q with a row of p is larger: the smaller of the bound by radii and the
    bound by angles."""
    dot = float(q.centre @ p.centre)
    by_radius = dot + q.radius * p.norm + p.radius * q.norm + q.radius * p.radius
    if q.norm == 0 or p.norm == 0:
        return by_radius
    between = math.acos(max(-1.0, min(1.0, dot / (q.norm * p.norm)))) - q.angle - p.angle
    return min(by_radius, max(0.0, math.cos(max(0.0, between))) * q.longest * p.longest)


def build(x: np.ndarray, idx: np.ndarray, centre: int | None = None, leaf: int = LEAF) -> Node:
    """Cover tree over rows ``idx`` of ``x``: a node's children are points of it more than radius / SHRINK
    apart, each covering the rows within that distance that no earlier child took."""
    centre = int(idx[0]) if centre is None else centre
    dist = np.sqrt(np.maximum(((x[idx] - x[centre]) ** 2).sum(axis=1), 0))
    radius = float(dist.max())
    if len(idx) <= leaf or radius == 0:
        return Node(x, x[centre], radius, idx, [])
    reach = radius / SHRINK
    children: list[Node] = []
    left = idx[np.argsort(dist, kind="stable")]
    net: list[tuple[int, np.ndarray]] = []
    while len(left) and len(net) <= max(16, len(idx) // leaf * 2):
        pivot = int(left[0])
        own = np.sqrt(np.maximum(((x[left] - x[pivot]) ** 2).sum(axis=1), 0)) <= reach
        net.append((pivot, left[own]))
        left = left[~own]
    if len(left):  # too spread for a net of this reach: what is left is one more child with a radius of its own
        net.append((int(left[0]), left))
    if len(net) == 1:
        return Node(x, x[centre], radius, idx, [])
    small: list[np.ndarray] = []
    for pivot, own in net:
        tight = len(own) > 2 and float(((x[own] - x[pivot]) ** 2).sum(axis=1).max()) < (radius / 4) ** 2
        if (tight or len(own) >= leaf // 4) and len(own) < len(idx):
            children.append(build(x, own, pivot, leaf))
        else:
            small.append(own)
    if small:  # points that cover next to nothing, and loose handfuls, share leaves
        rest = np.concatenate(small)
        if len(rest) == len(idx):
            return Node(x, x[centre], radius, idx, [])
        for lo in range(0, len(rest), leaf):
            part = rest[lo : lo + leaf]
            d = np.sqrt(np.maximum(((x[part] - x[part[0]]) ** 2).sum(axis=1), 0))
            children.append(Node(x, x[part[0]], float(d.max()), part, []))
    return Node(x, x[centre], radius, idx, children)


def search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, point_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids), both queries x k, best first; LOWEST marks an empty place. Scores below ``floor``, one a
    query, need not be found. Integer arrays are multiplied as integers."""
    scores = np.full((len(queries), k), LOWEST, np.int64)
    ids = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
    if not len(queries) or not len(points):
        return scores, ids
    floor = np.full(len(queries), LOWEST) if floor is None else floor
    qt = build(queries.astype(np.float64), np.arange(len(queries)), leaf=QUERY_LEAF)
    pt = build(points.astype(np.float64), np.arange(len(points)))
    slack = 1e-6

    stack = [(most(qt, pt), qt, pt)]
    while stack:
        b, q, p = stack.pop()
        if b + slack * (1 + abs(b)) < np.maximum(scores[q.idx, -1], floor[q.idx]).min():
            continue
        if not q.children and not p.children:
            _leaves(q.idx, p.idx, queries, query_ids, points, point_ids, scores, ids, k)
            continue
        if q.children and (not p.children or q.radius >= p.radius):
            pairs = [(most(c, p), c, p) for c in q.children]
        else:
            pairs = [(most(q, c), q, c) for c in p.children]
        stack += sorted(pairs, key=lambda t: t[0])  # the best is popped first
    return scores, ids


def _leaves(qi, pi, queries, query_ids, points, point_ids, scores, ids, k) -> None:
    for lo in range(0, len(pi), 4096):  # a leaf of equal points may be large
        at = pi[lo : lo + 4096]
        s = queries[qi] @ points[at].T
        s = s if s.dtype == np.int64 else np.rint(s).astype(np.int64)
        s[query_ids[qi][:, None] == point_ids[at][None, :]] = LOWEST
        all_s = np.concatenate([scores[qi], s], axis=1)
        all_i = np.concatenate([ids[qi], np.broadcast_to(point_ids[at], s.shape)], axis=1)
        all_i = np.where(all_s == LOWEST, np.iinfo(np.int64).max, all_i)
        if all_s.shape[1] > 4 * k:
            kth = -np.partition(-all_s, k - 1, axis=1)[:, k - 1 : k]
            all_i = np.where(all_s < kth, np.iinfo(np.int64).max, all_i)
        order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
        scores[qi] = np.take_along_axis(all_s, order, axis=1)
        ids[qi] = np.take_along_axis(all_i, order, axis=1)


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): usable rows as array<bigint>."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(fine).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("bigint")).alias("v"))


def bounds(centres: np.ndarray, q_radius: np.ndarray, p_radius: np.ndarray) -> np.ndarray:
    """No inner product of a row of query cell i with a row of cell j is above [i, j]."""
    norm = np.sqrt((centres**2).sum(axis=1))
    return centres @ centres.T + q_radius[:, None] * norm[None, :] + norm[:, None] * p_radius[None, :] + q_radius[:, None] * p_radius[None, :]


def _in_cells(ints: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot (``cell``) and the distance to it."""
    half = (pivots**2).sum(axis=1) / 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            x = np.stack(rows["v"].to_numpy()).astype(np.float64)
            cell = np.argmax(x @ pivots.T - half, axis=1)
            yield rows.assign(cell=cell.astype(np.int32), dist=np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)))

    return ints.mapInPandas(run, "vec_id bigint, v array<bigint>, cell int, dist double")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE, block_rows: int = 16_384, group_rows: int = 8_192, most_cells: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ints, _ = materialize(integer_vectors(vectors, scale=scale), "vectors")
    asks = F.col("vec_id") % every == 0
    peak = F.max(F.greatest(F.array_max("v"), -F.array_min("v")))
    sizes = ints.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(asks.cast("bigint")).alias("q"), peak.alias("peak"), F.count_distinct("vec_id", F.xxhash64("v")).alias("u")).limit(2).collect()
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(r.d for r in sizes)} and perhaps more")
    if not sizes or not sizes[0].q:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dim, rows, asked, largest = sizes[0].d, sizes[0].n, sizes[0].q, sizes[0].peak
    if dim * largest * largest >= 2**62:
        raise OverflowError(f"inner products of components up to {largest} pass 64-bit integers")
    kind = np.float64 if dim * largest * largest < 2**53 else np.int64
    if sizes[0].u < rows:
        ints = ints.dropDuplicates(["vec_id", "v"])  # partial sums first: a row that repeats without end is one row
    cells = min(most_cells, math.ceil(rows / block_rows))
    seeds = ints.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(cells).collect()  # at most most_cells rows
    pivots = np.array([r.v for r in seeds], np.float64)
    placed, path = materialize(_in_cells(ints, pivots), "cells")
    per = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r"), F.sum(asks.cast("bigint")).alias("q"), F.max(F.when(asks, F.col("dist"))).alias("rq")).collect()
    n, q = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    radius, q_radius = np.zeros(cells), np.zeros(cells)
    for r in per:
        n[r.cell], q[r.cell], radius[r.cell], q_radius[r.cell] = r.n, r.q, r.r, r.rq or 0.0
    blocks = np.maximum(1, -(-n // block_rows))
    # Query groups: cells whose pivots are nearest to one of a few pivots, cut by hash where they ask too much.
    heads = pivots[: max(1, math.ceil(asked / group_rows))]  # most_cells at most
    family = np.argmax(pivots @ heads.T - (heads**2).sum(axis=1) / 2, axis=1)
    splits = np.maximum(1, -(-np.bincount(family, weights=q, minlength=len(heads)).astype(np.int64) // (2 * group_rows)))

    def literal(values: np.ndarray, at: str) -> Column:
        """The value of a short array at a row's cell: a literal of most_cells numbers."""
        return F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col(at) + 1)

    block = F.pmod(F.xxhash64("vec_id", "v"), literal(blocks, "cell")).cast("int")
    points = placed.select("vec_id", "v", "cell", block.alias("block"))
    queries = spark.read.schema(placed.schema).parquet(path).where(asks).select("vec_id", "v", "cell", literal(family, "cell").alias("g")).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("q")), literal(splits, "g")).cast("int"))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "cell": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "cell": "int32", "vec_id": "int64", "score": "int64"})
        qi, pi = left["vec_id"].to_numpy(np.int64), right["vec_id"].to_numpy(np.int64)
        qv, pv = (np.stack(t["v"].to_numpy()).astype(kind) for t in (left, right))
        s, i = search(qv, qi, pv, pi, k, left["floor"].to_numpy(np.int64))
        live = s > LOWEST
        return pd.DataFrame({"query_id": np.repeat(qi, k)[live.ravel()], "cell": np.repeat(left["cell"].to_numpy(np.int32), k)[live.ravel()], "vec_id": i[live], "score": s[live]})

    out = "query_id bigint, cell int, vec_id bigint, score bigint"
    # 1. every query against one block of its own cell
    first = queries.select("vec_id", "v", "cell", F.lit(LOWEST).alias("floor"), "part")
    own, _ = materialize(first.groupBy("cell", "part").cogroup(points.where("block = 0").select("*", _up_to(literal(splits[family], "cell"), "part")).groupBy("cell", "part")).applyInPandas(pair, out), "own")
    kth = own.groupBy("query_id", "cell").agg(F.when(F.count("*") >= k, F.array_sort(F.collect_list("score"), lambda a, b: F.sign(b - a).cast("int"))[k - 1]).alias("floor"))
    floors, _ = materialize(queries.select("vec_id", "cell").distinct().join(kth.withColumnRenamed("query_id", "vec_id"), ["vec_id", "cell"], "left").select("vec_id", "cell", F.coalesce("floor", F.lit(LOWEST)).alias("floor")), "floors")
    worst = np.full(cells, np.inf)
    for r in floors.groupBy("cell").agg(F.min("floor").alias("w")).collect():
        worst[r.cell] = r.w
    # 2. pairs of cells that may still hold a better score; own cells are done but for their other blocks
    top = bounds(pivots, q_radius, radius)
    live = (top + 1e-6 * (1 + np.abs(top)) >= worst[:, None]) & (q > 0)[:, None] & (n > 0)[None, :]
    wanted = sorted({(int(family[i]), int(j)) for i, j in np.argwhere(live)})
    pairs = F.broadcast(spark.createDataFrame(wanted, "g int, cell int"))  # most_cells^2 rows of two numbers at most
    # 3. the trees of each remaining (group, block)
    keys = ["g", "part", "cell", "block"]
    right = points.join(pairs, "cell").select("*", _up_to(literal(splits, "g"), "part"))
    left = queries.join(floors, ["vec_id", "cell"]).withColumnRenamed("cell", "home").join(pairs, "g").select("*", _up_to(literal(blocks, "cell"), "block"))

    def pair_home(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pair(a.drop(columns=["cell"]).rename(columns={"home": "cell"}), b)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair_home, out)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _up_to(n: Column, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias(name)


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, p.vec_id, list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q, v p WHERE q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
