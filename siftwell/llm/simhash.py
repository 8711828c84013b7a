"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Fingerprints: XXH64 (seed 42) of every 3-word shingle of the text, repeats included; bit b of the
fingerprint is 1 when more than half the shingle hashes have it. Two fingerprints link when they
differ in at most ``radius`` (2) bits; a component is what links reach.

Search, over the distinct fingerprints only:

1. the 64 bits are grouped into m partitions so that correlated bits share one (greedy, on the bit
   correlations of all fingerprints);
2. each partition i gets a threshold T_i >= -1 with sum(T_i) = radius - m + 1, chosen by dynamic
   programming on the estimated number of rows that its probes make. The estimates use counts over all
   fingerprints (bit marginals; exact self-join sizes at T_i = 0). m itself is picked the same way.
   Generalised pigeonhole: any linking pair agrees within T_i in some partition i;
3. every fingerprint is stored under its own value of each partition in use and probes all values within
   T_i of it; a probe meets what is stored there, never another probe, and of two fingerprints that would
   find each other only the larger one's probe counts. What meets is verified on all 64 bits. The costs of
   step 2 are those of this search: a row for each store and probe, a check for each meeting.

A bucket that stores more than ``hot_bucket`` fingerprints, or is probed by more than ``HOT_PROBES`` times as
many, is never paired up. Its stored and probing members take the exact way around: each emits itself and its
64 one-bit neighbours, and members that meet in such a ball (distance <= 2, and only those) are tied to the
smallest of the meeting. That costs 65 rows a member, whatever the size of the bucket, and loses no connection.

Components are found by alternating large-star and small-star steps on tables in the shared folder, or on the
driver where the links are few (their number is counted first; a bound, not a cut). The root
of a giant component, or a very frequent fingerprint, is one join key with many rows on one side: adaptive
execution splits that side (spark.sql.adaptive.skewJoin), the other has a row a key.
Null and empty texts have fingerprint zero and link like others; rows with a null doc_id take part and
a component of none but null ids has a null id; repeated rows come back as often as they came in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import discard, materialize, slices, temporary, texts

BITS = 64
SEED = 42
RADIUS = 2
HOT_PROBES = 16
DRIVER_EDGES = 200_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() is A-Z only
    if not words:
        return 0
    n = len(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = starts[width:] + [at]  # one past the blank after each shingle
    h = np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends)], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 65536):  # 4 MB of bits at a time, however long the text
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, key: Column | None = None) -> DataFrame:
    """(doc_id, fp), with ``key``, a long, (doc_id, fp, key): the fingerprint as a signed long of the same bits."""
    names = ["doc_id", "fp"] if key is None else ["doc_id", "fp", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], names=names)

    slim = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), *([] if key is None else [key.alias("key")]))
    return slim.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def bit_sums(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and the 64 x 64 counts of bits set together (one matrix a task is summed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = 0, np.zeros((BITS, BITS))
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for k in range(0, len(bits), 1 << 16):  # float32 counts stay exact below 2^24
                part = bits[k : k + (1 << 16)]
                gram += part.T @ part
            total += len(bits)
        at = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.append(gram.ravel(), total).astype(np.int64), pa.int64())], names=["at", "n"])

    rows = fps.select("fp").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r.at] = r.n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_groups(total: int, gram: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits into m groups of 64/m, correlated bits together: seed each with the bit that is
    most tied to the rest, then add the bit of the highest mean |correlation| with the group."""
    p = np.diag(gram) / max(total, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((gram / max(total, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for g in range(m):
        size = (BITS * (g + 1)) // m - (BITS * g) // m
        own = [max(free, key=lambda b: (corr[b, list(free)].sum(), -b))]
        free.remove(own[0])
        while len(own) < size:
            nxt = max(free, key=lambda b: (corr[b, own].mean(), -b))
            own.append(nxt)
            free.remove(nxt)
        groups.append(sorted(own))
    return groups


def value_of(fp: str | Column, bits: list[int]) -> Column:
    """The bits of one partition, left in place: fp AND mask."""
    mask = sum(1 << b for b in bits)
    return (F.col(fp) if isinstance(fp, str) else fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("bigint"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def expected_pairs(total: int, gram: np.ndarray, bits: list[int], most: int, exact: float) -> list[float]:
    """Estimated meetings of stores and probes (each pair once) of a partition at T = 0..most: the exact count at 0, then scaled by
    the chance of t mismatches to none when bits differ as often as their marginals say."""
    p = np.diag(gram)[bits] / max(total, 1)
    differ = 2 * p * (1 - p)
    ways = np.zeros(most + 1)
    ways[0] = 1.0
    for d in differ:
        ways[1:] = ways[1:] * (1 - d) + ways[:-1] * d
        ways[0] *= 1 - d
    cum = np.cumsum(ways) * total * total / 2
    return [exact + cum[t] - cum[0] for t in range(most + 1)]


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds T_i >= -1 with sum(T_i) = budget of the least total cost; costs[i][t + 1] is partition
    i at threshold t, and t = -1 (no probe) costs nothing. Dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, picks) in best.items():
            for t, c in enumerate(row):
                key = spent + t - 1
                if key not in nxt or cost + c < nxt[key][0]:
                    nxt[key] = (cost + c, [*picks, t - 1])
        best = nxt
    return best[budget]


def plan_search(fps: DataFrame, radius: int = RADIUS, choices: tuple[int, ...] = (2, 3, 4)) -> tuple[list[tuple[list[int], int]], int]:
    """The partitions in use with their thresholds, and the number of fingerprints."""
    total, gram = bit_sums(fps)
    grouped = {m: correlated_groups(total, gram, m) for m in choices if m <= radius + 2}
    parts = [(m, i, bits) for m, groups in grouped.items() for i, bits in enumerate(groups)]
    keyed = fps.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), value_of("fp", bits).alias("v")) for k, (_, _, bits) in enumerate(parts)])).alias("s"))
    same = {r.k: float(r.n) for r in keyed.groupBy("s.k", "s.v").agg(F.count("*").cast("double").alias("c")).groupBy("k").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("n")).collect()}
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for m, groups in grouped.items():
        costs = []
        for i, bits in enumerate(groups):
            exact = same.get(parts.index((m, i, bits)), 0.0)
            pairs = expected_pairs(total, gram, bits, radius, exact)
            probes = [sum(math.comb(len(bits), j) for j in range(t + 1)) for t in range(radius + 1)]
            costs.append([0.0] + [total * (1 + probes[t] * (t > 0)) + pairs[t] for t in range(radius + 1)])
        cost, picks = allocate(costs, radius - m + 1)
        if cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(groups, picks) if t >= 0])
    return best[1], total


def near_masks(bits: list[int], most: int) -> list[int]:
    """XOR masks that reach every value within ``most`` bits."""
    return [signed(sum(1 << b for b in c)) for t in range(most + 1) for c in combinations(bits, t)]


def probe_keys(k: int, bits: list[int], most: int) -> Column:
    """array<struct<k, v, own>>: the values of partition k within ``most`` bits of the fingerprint's own."""
    own = value_of("fp", bits)
    masks = F.array(*[F.lit(x).cast("bigint") for x in near_masks(bits, most)])
    return F.transform(masks, lambda x: F.struct(F.lit(k).alias("k"), own.bitwiseXOR(x).alias("v"), (x == 0).alias("own")))


def links(fps: DataFrame, radius: int = RADIUS, hot_bucket: int = 128) -> DataFrame:
    """(u, v), u < v: links between distinct fingerprints whose closure is that of all links.

    ``fps``: one row per distinct fingerprint. A bucket of bounded size is verified straight from its gathered
    arrays; larger ones take the 65-row star (radius 2 only)."""
    if radius != 2:
        raise ValueError("the way around hot buckets needs a radius of 2")
    plan, total = plan_search(fps, radius)
    if total < 2:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where(F.lit(False))
    keys = [probe_keys(k, bits, most) for k, (bits, most) in enumerate(plan)]
    probes = fps.select("fp", F.explode(F.concat(*keys)).alias("s")).select("fp", "s.k", "s.v", "s.own")
    # Bucket sizes first (partial sums), so that a hot bucket is known before anything is gathered.
    sizes = probes.groupBy("k", "v").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("bigint")).alias("held"))
    is_hot = (F.col("held") > hot_bucket) | ((F.col("held") > 0) & (F.col("n") - F.col("held") > HOT_PROBES * hot_bucket))
    hot, _ = materialize(sizes.where(is_hot).select("k", "v"), "hot")
    cold = probes.join(hot, ["k", "v"], "left_anti")
    packed = cold.groupBy("k", "v").agg(F.sort_array(F.collect_list(F.when(F.col("own"), F.col("fp")))).alias("m"), F.collect_list(F.when(~F.col("own"), F.col("fp"))).alias("p"))
    packed = packed.where((F.size("m") > 0) & (F.size("m") + F.size("p") > 1))
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius
    pair = lambda a, b: F.struct(a.alias("u"), b.alias("v"))
    # Verified inside the row: only links leave it, never all pairs.
    stored = F.transform("m", lambda a, i: F.transform(F.filter(F.slice(F.col("m"), i + 2, F.size("m")), lambda b: near(a, b)), lambda b: pair(a, b)))
    probed = F.transform("m", lambda a: F.transform(F.filter(F.col("p"), lambda b: (b > a) & near(a, b)), lambda b: pair(a, b)))
    pairs = packed.select(F.explode(F.concat(F.flatten(stored), F.flatten(probed))).alias("e")).select("e.u", "e.v")
    members = probes.join(hot, ["k", "v"], "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(signed(1 << b)).cast("bigint") for b in range(BITS)])
    balls = members.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("mid"))
    least = balls.groupBy("mid").agg(F.min("fp").alias("u"), F.max("fp").alias("top"), F.count("*").alias("n")).where("n > 1")
    small = least.where("n = 2").select("u", F.col("top").alias("v"))
    wide = balls.join(least.where("n > 2").select("mid", "u"), "mid").where("u <> fp").select("u", F.col("fp").alias("v"))
    return pairs.union(small).union(wide).distinct()


def driver_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their roots (least nodes) of a small graph; roots themselves are left out."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        nxt = root.copy()
        for ends in (a, b, root[a], root[b]):  # an end and its root take the lower root of an edge
            np.minimum.at(nxt, ends, low)
        nxt = nxt[nxt]
        if (nxt == root).all():
            return nodes[root < np.arange(len(nodes))], nodes[root[root < np.arange(len(nodes))]]
        root = nxt


def components(edges: DataFrame, most_rounds: int = 60, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(node, root): the least node of each component of the graph of ``edges`` (u, v), by alternating
    large-star and small-star; a star forest is reached in about log(n) rounds. Of ``driver_edges`` edges at
    most (16 bytes each) the driver finds them without a job a round."""
    spark = edges.sparkSession
    now, path = materialize(edges.select("u", "v"), "edges")
    if now.count() <= driver_edges:
        got = now.toArrow()
        node, root = driver_components(*(got.column(c).to_numpy() for c in ("u", "v")))
        return spark.createDataFrame(pa.table({"node": pa.array(node, pa.int64()), "root": pa.array(root, pa.int64())}), "node bigint, root bigint")
    before = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(lows, "u").where("v > u").select(F.col("low").alias("u"), "v").distinct()
        mid, mid_path = materialize(large.where("u <> v"), "large")
        downs = mid.select(F.col("v").alias("hi"), F.col("u").alias("lo"))
        lows = downs.groupBy("hi").agg(F.min("lo").alias("low"))
        small = downs.join(lows, "hi").select(F.col("low").alias("u"), F.explode(F.array("hi", "lo")).alias("v")).where("u <> v").distinct()
        nxt, nxt_path = materialize(small, "small")
        state = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(spark, path, mid_path)
        now, path = nxt, nxt_path
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) of the fingerprints of ``prints``: root, a fingerprint, names the group, and
    component_id is its least doc_id (null where no row of it has one)."""
    with temporary(prints.sparkSession) as keep:
        out, path = _classes(prints, radius)
        keep.append(path)
    return out


def _classes(prints: DataFrame, radius: int) -> tuple[DataFrame, str]:
    first, _ = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    forest, _ = materialize(components(links(first.select("fp"), radius)), "forest")
    # Roots are members too; a component's id is the least doc_id of all its fingerprints.
    tied = forest.select(F.col("node").alias("fp"), "root").union(forest.select(F.col("root").alias("fp"), "root").distinct())
    known = tied.join(first, "fp")
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = known.join(ids, "root").select("fp", "root", "component_id")
    final = first.join(moved, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return materialize(final, "classes")


def near_groups(docs: DataFrame, text: str = "text", radius: int = RADIUS, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): every row with the least doc_id that its links reach."""
    prints, _ = materialize(fingerprints(docs, text, width), "fp")
    return prints.join(classes(prints, radius).select("fp", "component_id"), "fp")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The pipeline's form: one row of each group stays, the one with the least doc_id (null ones last), then
    the least hash of the row, whatever other rows share its doc_id.

    Texts are shuffled once, to meet the ids and hashes that stay (hashed, so the texts are not sorted); only
    rows that came several times are grouped."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    key = F.xxhash64(*cols, *[F.col(c).isNull() for c in cols])  # null and "" are not the same
    prints, _ = materialize(fingerprints(docs, key=key), "fp")
    rows = prints.groupBy("fp", "doc_id", "key").agg(F.count("*").alias("n")).join(classes(prints).select("fp", "root"), "fp")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n")).alias("least")
    groups, _ = materialize(rows.groupBy("root").agg(least).select(F.col("least.doc_id").alias("id"), F.col("least.key").alias("own"), F.col("least.n").alias("n")), "keep")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("id")) & (F.col("key") == F.col("own"))
    kept = docs.select(*cols, key.alias("key")).join(groups.hint("shuffle_hash"), same, "left_semi")
    again = groups.where("n > 1")
    if not again.isEmpty():
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "key"]))
    return kept.select(*cols)
