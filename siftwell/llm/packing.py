"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

A document's ids are its tokens and one closing id 0; only documents longer than ``capacity`` are cut,
into full pieces and a last one. The packing problem depends on the pieces' lengths alone, so it is
solved on their histogram: at most ``capacity`` counts, whatever the corpus. That is all the driver
sees.

1. Reduction: for a length a, the set {a, b} (b the longest that fits beside a) is fixed when it
   dominates every other set that holds a: nothing fits beside a; or a + b fills the sequence; or no two
   pieces fit beside a; or no three do and b is at least any pair that fits; likewise {a, b, s} when
   every pair that fits is covered by b and s. Fixed sets leave the instance; repeat until none is left
   to fix. Equal lengths are fixed together, by count.
2. Best fit, longest first, packs the remainder, again by count: equal sequences stay one group.

Pieces then get a rank among those of their length (a salted two-step count: no length is gathered in
one task) and take the slot of that rank. Null texts count as empty (one id); repeated rows are pieces
of their own; a null doc_id is kept.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import gathered, materialize, slices, texts
from siftwell.llm.tokens import encoder

CAPACITY = 2048
PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, vocabulary: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every row: doc_id, piece, start, length and the crc32 of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = encoder(vocabulary).encode_many, 4 * capacity
        for batch in slices(gathered(batches)):
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()])):
                raw = ids + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    for c, v in zip(cols, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, PIECE_SCHEMA)


class Shelf:
    """The lengths still to be packed, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.count = {a: n for a, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, used: dict[int, int], times: int) -> None:
        for a, k in used.items():
            self.count[a] -= k * times
            if not self.count[a]:
                del self.count[a]
                self.sizes.pop(bisect_left(self.sizes, a))

    def left(self, a: int, used: dict[int, int]) -> int:
        return self.count.get(a, 0) - used.get(a, 0)

    def largest(self, room: int, used: dict[int, int]) -> int:
        """The longest piece of at most ``room`` outside ``used``; 0 if none."""
        i = bisect_left(self.sizes, room + 1) - 1
        while i >= 0 and self.left(self.sizes[i], used) <= 0:
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def smallest_sum(self, k: int, used: dict[int, int]) -> int | None:
        """The sum of the k shortest pieces outside ``used``; None if there are fewer."""
        total = 0
        for a in self.sizes:
            n = min(k, max(0, self.left(a, used)))
            total += n * a
            k -= n
            if not k:
                return total
        return None


def dominating(shelf: Shelf, a: int, capacity: int) -> dict[int, int] | None:
    """A set holding ``a`` that dominates all others that hold it, as length -> times; None if none is found."""
    own, room = {a: 1}, capacity - a
    b = shelf.largest(room, own)
    if not b:
        return own
    pair = {a: 1, b: 1} if a != b else {a: 2}
    if b == room:
        return pair
    two = shelf.smallest_sum(2, own)
    if two is None or two > room:
        return pair
    three = shelf.smallest_sum(3, own)
    if three is not None and three <= room:
        return None
    # At most two pieces fit beside a: all pairs (x, y), x >= y, that fit.
    s = shelf.largest(room - b, pair)
    covered = lone = True
    for x in shelf.sizes:
        if shelf.left(x, own) <= 0 or x > room:
            continue
        used = own | {x: own.get(x, 0) + 1}
        y = min(shelf.largest(min(x, room - x), used), x)
        if y and x + y > b:
            lone = False
            if y > s:
                covered = False
    if lone:
        return pair
    if s and covered:
        return pair | {s: pair.get(s, 0) + 1}
    return None


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Groups of equal sequences: (how many, the lengths in one), reduction first, then best fit."""
    shelf, groups = Shelf(counts), []
    moved = True
    while moved:
        moved = False
        for a in sorted(shelf.sizes, reverse=True):
            while shelf.count.get(a) and (found := dominating(shelf, a, capacity)):
                times = min(shelf.count[x] // k for x, k in found.items())
                groups.append((times, sorted((x for x, k in found.items() for _ in range(k)), reverse=True)))
                shelf.take(found, times)
                moved = True
    return groups + best_fit(shelf.count, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing by counts: a piece goes where the least room is left, so a sequence that takes
    one of a length takes as many as fit before the next does."""
    open_: dict[int, list[list]] = {}  # room -> [[how many, lengths]]
    rooms: list[int] = []

    def put(room: int, n: int, lengths: list[int]) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append([n, lengths])

    for a in sorted(counts, reverse=True):
        n = counts[a]
        while n:
            i = bisect_left(rooms, a)
            if i < len(rooms):
                room = rooms[i]
                have, lengths = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, have, lengths = capacity, n, []
            fit = room // a
            full = min(have, n // fit)
            put(room - fit * a, full, lengths + [a] * fit)
            n -= full * fit
            have -= full
            if n and have:  # fewer than fit are left: one sequence takes them
                put(room - n * a, 1, lengths + [a] * n)
                n, have = 0, have - 1
            if lengths:
                put(room, have, lengths)
    return [(n, lengths) for room in rooms for n, lengths in open_[room]]


def slots(groups: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Runs of slots by length and rank: rank r in [lo, next lo) sits in sequence base + (r - lo) // times
    at offset + (r - lo) % times * length."""
    rows, seen, base = [], {}, 0
    for n, lengths in groups:
        offset = 0
        for a in sorted(set(lengths), reverse=True):
            times = lengths.count(a)
            lo = seen.get(a, 0)
            rows.append((a, lo, base, times, offset))
            seen[a] = lo + n * times
            offset += times * a
        base += n
    rows.sort()
    return {k: np.array(v, np.int64) for k, v in zip(("length", "lo", "base", "times", "offset"), zip(*rows))} if rows else {}


def pack(docs: DataFrame, vocabulary: str | None = None, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    # "__at" is written with the rows: it tells repeated rows apart, so that they too are ranked in many parts.
    cut, _ = materialize(pieces(docs, vocabulary or default_vocabulary(), text, capacity).withColumn("__at", F.monotonically_increasing_id()), "pieces")
    counts = {int(r.length): int(r.n) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = slots(solve(counts, capacity))
    salts = int(min(4096, max(64, sum(counts.values()) // 500_000)))  # ranks are counted in so many parts of a length
    salted = cut.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "__at"), F.lit(salts)))
    per = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32", "__at")
    ranked = salted.withColumn("__row", F.row_number().over(inner) - 1).join(base, ["length", "__salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__base") + F.col("__row")).cast("bigint").alias("rank"))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = {a: i for i, a in reversed(list(enumerate(runs["length"].tolist())))} if runs else {}
        ends = np.append(np.unique(runs["length"], return_index=True)[1], len(runs["length"])) if runs else None
        after = dict(zip(np.unique(runs["length"]).tolist(), ends[1:].tolist())) if runs else {}
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for a in np.unique(length):
                at = np.flatnonzero(length == a)
                lo, hi = first[int(a)], after[int(a)]
                k = lo + np.searchsorted(runs["lo"][lo:hi], rank[at], side="right") - 1
                j = rank[at] - runs["lo"][k]
                seq[at] = runs["base"][k] + j // runs["times"][k]
                off[at] = runs["offset"][k] + j % runs["times"][k] * a
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(seat, PIECE_SCHEMA + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(docs)
