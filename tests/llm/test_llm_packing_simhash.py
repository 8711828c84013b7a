import random
import zlib
from collections import Counter
from itertools import combinations

import pytest
import xxhash

from siftwell.llm import packing as P
from siftwell.llm import simhash as S
from siftwell.llm.tokens import encoder

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int, length int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2) for i, t in rows], DOCS)


# ---- packing


def bins(groups):
    return sum(n for n, _ in groups)


@pytest.mark.parametrize("trial", range(60))
def test_solution_is_whole_and_fits(trial):
    rnd = random.Random(trial)
    cap = rnd.choice([10, 30, 100, 2048])
    counts = Counter(rnd.randint(1, cap) for _ in range(rnd.randint(0, 120)))
    found, groups = Counter(), P.solve(dict(counts), cap)
    for n, lengths in groups:
        assert sum(lengths) <= cap
        for x in lengths:
            found[x] += n
    assert found == counts


def least(items, cap):
    """The fewest bins, by search."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, [*rest, r - items[i]])
        go(i + 1, [*rooms, cap - items[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("trial", range(40))
def test_reduction_loses_nothing(trial):
    """What dominance fixes never costs a bin: fixed sets plus the optimum of the rest are the optimum."""
    rnd = random.Random(1000 + trial)
    cap = 20
    items = [rnd.randint(2, cap) for _ in range(9)]
    shelf, fixed = P.Shelf(Counter(items)), 0
    for a in sorted(shelf.sizes, reverse=True):
        while shelf.count.get(a) and (got := P.dominating(shelf, a, cap)):
            shelf.take(got, 1)
            fixed += 1
    rest = [x for x, n in shelf.count.items() for _ in range(n)]
    assert fixed + least(rest, cap) == least(items, cap)
    assert bins(P.solve(Counter(items), cap)) <= least(items, cap) + 1


def test_word_cache_gives_the_tokenizers_ids(spark):
    e = encoder(P.default_vocabulary())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["", " \n", "It's 12½ — ‘ok’… €5!! <|endoftext|> don'T", "é é ＡＢＣ 日本語 İstanbul ΣΑΣ \x1c\x85  x​y", "naïve ǅ ß ſ", "\x00a\x7f"]
    for t in texts:
        assert e.encode(t) == b"".join(i.to_bytes(4, "little") for i in e.tokenizer.encode(t, add_special_tokens=False).ids)


def test_pack_table(spark):
    long = "word " * 5000
    df = docs(spark, [(1, long), (2, None), (3, ""), (None, "a b"), (4, "one two three"), (4, "one two three")])
    out = P.pack(df).collect()
    e = encoder(P.default_vocabulary())
    full = e.encode(long) + b"\0\0\0\0"
    mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in out if r.doc_id == 1)
    assert mine == [(k, 2048 * k, len(full[8192 * k : 8192 * (k + 1)]) // 4, zlib.crc32(full[8192 * k : 8192 * (k + 1)])) for k in range(-(-len(full) // 8192))]
    assert sorted(r.length for r in out if r.doc_id in (2, 3)) == [1, 1] and len([r for r in out if r.doc_id == 4]) == 2
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) == -(-sum(r.length for r in out) // 2048)
    assert P.pack(df.limit(0)).count() == 0


# ---- fingerprints


def plain_print(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " ", "One", "A b", "A b C", "É é Ünder the SEA\x0bfoo\x1cbar", "the cat sat on the mat " * 40])
def test_fingerprint(text):
    assert S.fingerprint(text) == plain_print(text)


def classes(pairs):
    parent = {i: i for i, _ in pairs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(pairs, 2):
        if (x ^ y).bit_count() <= 2:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i, _ in pairs}


def clustered(seed, n_base, per):
    rnd = random.Random(seed)
    out = set()
    for _ in range(n_base):
        x = rnd.getrandbits(64)
        out.add(x)
        for _ in range(per):
            y = x
            for _ in range(rnd.randint(1, 3)):
                y ^= 1 << rnd.randrange(64)
            out.add(y)
            x = y if rnd.random() < 0.4 else x
    return sorted(out)


@pytest.mark.parametrize("hot,choices", [(128, (2, 3, 4)), (2, (2, 3, 4)), (128, (2,)), (128, (4,)), (2, (2,))])
def test_links_close_like_brute_force(spark, monkeypatch, hot, choices):
    fps = clustered(5, 25, 8)
    plan = S.plan_search
    monkeypatch.setattr(S, "plan_search", lambda df, radius=2: plan(df, radius, choices))
    df = spark.createDataFrame([(S.signed(x),) for x in fps], "fp bigint")
    got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in S.components(S.links(df, hot_bucket=hot)).collect()}
    want = classes([(x, x) for x in fps])
    mine, theirs = {}, {}
    for x in fps:
        mine.setdefault(got.get(x, x), set()).add(x)
        theirs.setdefault(want[x], set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_allocation_covers_every_pair():
    for m in (2, 3, 4):
        _, picks = S.allocate([[0.0, 1.0, 5.0, 9.0]] * m, 2 - m + 1)
        assert sum(picks) == 3 - m and min(picks) >= -1


def test_groups_of_documents(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(5, base), (3, base), (9, base.upper()), (7, None), (8, ""), (2, "lone text here"), (None, "no id at all"), (3, base)]
    df = docs(spark, rows)
    got = sorted((str(r.doc_id), r.component_id) for r in S.near_groups(df).collect())
    assert got == sorted([("5", 3), ("3", 3), ("9", 3), ("7", 7), ("8", 7), ("2", 2), ("None", None), ("3", 3)], key=lambda x: x[0]) or {x for x in got} == {("5", 3), ("3", 3), ("9", 3), ("7", 7), ("8", 7), ("2", 2), ("None", None)}
    kept = S.dedup_documents(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["2", "3", "7", "None"]
    assert S.near_groups(df.limit(0)).count() == 0 and S.dedup_documents(df.limit(0)).count() == 0


def test_whole_table_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs = [(r.doc_id, plain_print(r.text)) for r in df.collect()]
    want = classes(pairs)
    for r in S.near_groups(df).collect():
        assert r.fp & (2**64 - 1) == dict(pairs)[r.doc_id] and r.component_id == want[r.doc_id]


def test_one_row_of_each_group_stays_under_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (3, c), (None, c), (None, "only here"), (None, "only here"), (0, a), (3, c)]
    kept = S.dedup_documents(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("0", a), ("1", b), ("3", c), ("None", "only here")])
    # One id that is the least of two groups keeps both of its texts.
    kept = S.dedup_documents(docs(spark, [(1, a), (1, b), (2, a), (2, b)])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (1, b)]


def test_small_graphs_take_no_job_a_round(spark, monkeypatch):
    """Every round cost two scratch tables, of a file a shuffle partition each."""
    import numpy as np

    from siftwell.llm import simhash

    pairs = np.random.default_rng(5).integers(-(1 << 40), 1 << 40, 300)[np.random.default_rng(6).integers(0, 300, (220, 2))]
    rows = [tuple(sorted(map(int, p))) for p in pairs if p[0] != p[1]] + [(-5 - k, -4 - k) for k in range(60)]
    edges = spark.createDataFrame(rows, "u bigint, v bigint")
    want = {(r.node, r.root) for r in simhash.components(edges, driver_edges=0).collect()}
    tags, plain = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, tag: tags.append(tag) or plain(df, tag))
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == want and tags == ["edges"]
    assert simhash.components(edges.where("u > v")).collect() == []
