"""Classifiers by held-out accuracy, exact search, mixing and revisits by SQL or brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import cover_tree as C
from siftwell.llm import line_crf, mixing, revisits, toxicity
from siftwell.llm.common import table

SF = "/root/testdata/sf0.01"


def held_out(df, labels, column):
    rows = df.where("held_out").join(labels.select("doc_id", column), "doc_id").collect()
    return np.mean([r.predicted == r[column] for r in rows])


def test_quality_on_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = line_crf.score_documents(docs, labels)
    assert held_out(out, labels, "quality") >= 0.97
    assert out.where("score < 0 or score > 1 or score is null").count() == 0 and out.count() == docs.count()


def test_toxicity_on_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = toxicity.score_documents(docs, labels)
    assert held_out(out, labels, "toxic") >= 0.92
    assert out.where("score < 0 or score > 1 or score is null").count() == 0 and out.count() == docs.count()


def test_disguised_insults_score_above_clean_words():
    rng = np.random.default_rng(0)
    clean = [{"".join(rng.choice(list("abcdefghilmnoprstu"), 6)) for _ in range(30)} for _ in range(200)]
    rows = [(0, b) for b in clean[:150]] + [(1, b | {w}) for b, w in zip(clean[150:], ["idiot", "moron", "stupid"] * 17)]
    model = toxicity.fit(rows, {0: 150, 1: 50})
    v = lambda t: model.values([t], {})[0]
    for bad in ("you idiot", "you id.iot", "i d i o t", "idxiot", "mooron", "stu-pid", "STUPID!"):
        assert v(bad) > v("you master string taskforce"), bad
    assert v("") == v(None) == toxicity.LEAST


def naive_subsequences(word):
    """Every gapped three-character subsequence by enumeration, opening mark included; letters as the kernel's classes."""
    from itertools import combinations

    def letter(ch):
        return 41 if ch == toxicity.OPEN else ord(ch) - 96 if "a" <= ch <= "z" else 27 if "0" <= ch <= "9" else 28 + ord(ch) % 13

    chars, out = toxicity.OPEN + word, {}
    for at in combinations(range(len(chars)), 3):
        if (span := at[2] - at[0] + 1) <= toxicity.SPAN:
            key = tuple(letter(chars[i]) for i in at)
            out[key] = out.get(key, 0) + toxicity.DECAY**span
    return out


def test_kernel_equals_enumeration():
    words = ["idiot", "idxiot", "aaaaaaaa", "lichlich", "ox", "x", "réeux", "w0rd9", "stone"]
    marks = ["idiots", "stony", "lich", "aaaa", "y"]
    got = toxicity.Landmarks(marks).kernel(words, block=4)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            a, b = naive_subsequences(w), naive_subsequences(m)
            norm = np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
            assert abs(got[i, j] - (sum(v * b.get(k, 0) for k, v in a.items()) / norm if norm else 0)) < 1e-6


def test_sentence_values_are_sums_over_landmarks():
    marks = toxicity.Landmarks(["idiot", "river"])
    model = toxicity.ToxicModel(marks, np.array([2.0, -1.0]), -0.5, np.array([1.0, 0.5, 0.25, -0.1]), 0.2, 0.5)
    k = lambda w: marks.kernel([w])[0] ** toxicity.POWER @ np.array([2.0, -1.0])
    one, two = -0.5 + k("you") + k("idiot"), -0.5 + k("the") + k("river")
    want = one + 0.5 * two - 0.25 * toxicity.CLIP - 0.1 * np.log(3) + 0.2
    assert abs(model.values(["You id.iot! The river, the river."], {})[0] - want) < 1e-6
    long = "word " * 100_000 + "idiot"
    assert len(toxicity.sentence_bags(long)) == 2501 and np.isfinite(model.values([long], {}, most=3)[0])


def test_toxicity_recall_and_precision():
    import zlib

    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist() if r["doc_id"] in toxic]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = [(toxic[i], [" ".join(sorted(b)) for b in toxicity.sentence_bags(t)]) for i, t in docs if not held(i)]
    model = toxicity.fit(rows, {y: sum(1 for r in rows if r[0] == y) for y in (0, 1)})
    y = np.array([toxic[i] for i, _ in docs if held(i)])
    hit = model.scores([t for i, t in docs if held(i)], {}) >= 0.3
    assert hit[y == 1].mean() >= 0.9 and y[hit].mean() >= 0.9 and (hit == y).mean() >= 0.97


def test_toxicity_edges(spark):
    schema = "doc_id bigint, text string, score string, predicted string, y int"
    rows = [(i, "the river runs by the town. you are a fine friend." if i % 3 else "you idiot. the river runs.", "x", None, 1) for i in range(60)]
    rows += [(None, None, None, None, None), (100, "", "", "", 1), (100, "", "", "", 1), (101, "idiot " * 50_000, "", "", 1)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(3, 1), (None, 1), (5, None)], "doc_id bigint, toxic int")
    out = toxicity.score_documents(docs, labels).collect()
    assert len(out) == len(rows) and {r.predicted for r in out if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 3} == {0}
    assert {r.predicted for r in out if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 3 == 0} == {1}
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_models_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None), (1, "a")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (None, 0, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")
    for labels in (none, one):
        for op in (line_crf, toxicity):
            rows = op.score_documents(docs, labels).collect()
            assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows)
    assert line_crf.score_documents(docs.limit(0), one).count() == 0


def test_crf_gradient():
    rng = np.random.default_rng(1)
    rows = [(int(y), [[int(i) for i in rng.choice(line_crf.N_FEATURES, 4, replace=False)] for _ in range(3)], [5, 6, 7]) for y in (0, 1)]
    f = line_crf.N_FEATURES
    x = np.zeros((2, 5, f), np.float64)
    for r, (_, feats, _) in enumerate(rows):
        x[r, 1:4] = line_crf.one_hot(feats)
    mask, y, wt = np.ones((2, 3), bool), np.array([r[0] for r in rows]), np.ones(2)
    w = rng.normal(size=3 * f + 7) * 0.3

    def loglik(w):
        total = 0
        for r in range(2):
            s = x[r, 1:-1] @ w[:f] + x[r, :-2] @ w[f : 2 * f] + x[r, 2:] @ w[2 * f : 3 * f] + w[3 * f]
            first, e = w[3 * f + 1 : 3 * f + 3], w[3 * f + 3 :].reshape(2, 2)
            path = lambda lab: first[lab[0]] + sum(s[t] * lab[t] for t in range(3)) + e[lab[0], lab[1]] + e[lab[1], lab[2]]
            every = [path((a, b, c)) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
            total += path((y[r],) * 3) - np.logaddexp.reduce(every)
        return total

    g = line_crf._gradient(w, x, mask, y, wt)
    for i in [*rng.choice(3 * f, 10), *range(3 * f, 3 * f + 7)]:
        d = np.zeros_like(w)
        d[i] = 1e-5
        assert abs((loglik(w + d) - loglik(w - d)) / 2e-5 - g[i]) < 1e-5


@pytest.mark.parametrize("seed", range(5))
def test_crf_value_equals_enumeration(seed):
    from itertools import product

    rng = np.random.default_rng(seed)
    n, f = 5, line_crf.N_FEATURES
    model = line_crf.LineCRF(*(rng.normal(size=f).astype(np.float32) for _ in range(3)), 0.3, rng.normal(size=2), rng.normal(size=(2, 2)))
    feats = [bytes(sorted(rng.choice(f, 4, replace=False).tolist())) for _ in range(n)]
    sizes = [int(x) for x in rng.integers(1, 40, n)]
    x = np.zeros((n + 2, f))
    x[1:-1] = line_crf.one_hot([list(q) for q in feats])
    s = x[1:-1] @ model.own + x[:-2] @ model.before + x[2:] @ model.after + model.bias
    weight, good = 0.0, np.zeros(n)
    for lab in product((0, 1), repeat=n):
        p = np.exp(model.first[lab[0]] + sum(s[t] * lab[t] for t in range(n)) + sum(model.edge[a, b] for a, b in zip(lab, lab[1:])))
        weight, good = weight + p, good + p * np.array(lab)
    share = float(np.average(good / weight, weights=sizes))
    two = model.document_values([(feats, sizes), ([bytes([line_crf.EMPTY])], [1])])
    assert abs(two[0] - np.log(share / (1 - share))) < 1e-5
    assert model.scores(["a line.\n" * 30_000, None]).shape == (2,)


def test_lines_take_the_label_that_their_own_features_tell():
    f = line_crf.N_FEATURES
    own = np.zeros(f, np.float32)
    own[3], own[5] = 5.0, -5.0
    model = line_crf.LineCRF(own, own * 0, own * 0, 0.0, np.zeros(2), np.zeros((2, 2)))
    assert line_crf.relabelled(model, 0, [bytes([5]), bytes([3]), bytes([7])]).tolist() == [0, 1, 0]
    assert line_crf.relabelled(model, 1, [bytes([5]), bytes([5])]).tolist() == [1, 0]


def test_classifier_stage_is_fitted_on_the_labelled_source(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    bad = [r.doc_id for r in labels.where("quality = 0").collect()]
    one_class = docs.where(~F.col("doc_id").isin(bad)).withColumn("score", F.lit("x"))
    junk = docs.where(F.col("doc_id").isin(bad)).limit(20)
    mixed = one_class.limit(100).unionByName(junk, allowMissingColumns=True)
    kept = line_crf.keep_good(mixed, labels, docs)
    model = line_crf.train(docs, labels)
    want = sorted(r.doc_id for r in mixed.collect() if model.scores([r.text])[0] >= 0.3)
    assert sorted(r.doc_id for r in kept.collect()) == want and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(set(want) & set(bad)) <= 2 and model.prior is None
    with pytest.warns(UserWarning, match="two classes"):
        assert line_crf.keep_good(mixed, labels.where("quality = 1"), docs).count() == mixed.count()
    assert line_crf.keep_good(docs.limit(0), labels, docs).count() == 0


# ---- search


@pytest.mark.parametrize("seed,n,dim,near", [(0, 300, 8, False), (1, 500, 3, True), (2, 40, 16, True), (3, 3, 2, False), (4, 400, 2, True)])
def test_dual_trees_are_exact(seed, n, dim, near):
    rng = np.random.default_rng(seed)
    x = np.rint(rng.normal(size=(n, dim)) * 100)
    if near:
        x[n // 2 :] = x[rng.integers(0, 5, n - n // 2)] + np.rint(rng.normal(size=(n - n // 2, dim)))
        x[-3:] = 0
    ids = rng.permutation(n * 2)[:n].astype(np.int64)
    q = ids % 3 == 0
    if not q.any():
        return
    s, i = C.search(x[q], ids[q], x, ids, 5)
    for a, row in enumerate(np.flatnonzero(q)):
        score = (x @ x[row]).astype(np.int64)
        want = sorted(((-score[j], ids[j]) for j in range(n) if ids[j] != ids[row]))[:5]
        assert [(-u, v) for u, v in want] == [(u, v) for u, v in zip(s[a], i[a]) if u > C.LOWEST]


def test_pruning_prunes(monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16)) * 1000
    x = np.rint(centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)))
    seen = []
    leaves = C._leaves
    monkeypatch.setattr(C, "_leaves", lambda qi, pi, *a: (seen.append(len(qi) * len(pi)), leaves(qi, pi, *a)))
    ids = np.arange(8000)
    C.search(x[::50], ids[::50], x, ids, 5)
    assert sum(seen) < 0.7 * 160 * 8000


def test_search_table(spark):
    rows = [(i, [float(np.sin(i + k)) for k in range(4)]) for i in range(120)] + [(500, None), (550, [1.0, float("nan"), 0.0, 0.0]), (600, [1.0, None, 0.0, 0.0]), (None, [1.0] * 4), (650, []), (50, [float(np.sin(50 + k)) for k in range(4)])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, score int, rank int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in C.top_k(df, block_rows=32, group_rows=1).collect()}
    v = {i: np.floor(256 * np.array(x, np.float32).astype(float)) for i, x in rows[:120]}
    for q in (0, 50, 100):
        want = sorted((-int(v[q] @ v[j]), j) for j in v if j != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(j, -s) for s, j in want]
    assert len(got) == 15 and C.top_k(df.limit(0)).count() == 0


def brute(rows, k=5, every=50):
    v = {i: [int(np.floor(256 * float(c))) for c in x] for i, x in rows}
    out = {}
    for i in v:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v[i], v[j])), j) for j in v if j != i)[:k]
            out |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e3, 3e5, 8e5])
def test_large_components_are_exact(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6) * scale]) for i in range(130)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in C.top_k(df, block_rows=40, group_rows=2).collect()} == brute(rows)


def test_what_top_k_refuses(spark):
    schema = "vec_id bigint, embedding array<double>"
    with pytest.raises(ValueError, match="lengths"):
        C.top_k(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], schema))
    with pytest.raises(OverflowError):
        C.top_k(spark.createDataFrame([(0, [1e9, 1.0]), (1, [1.0, 2.0])], schema))
    assert C.top_k(spark.createDataFrame([(1, [1.0])], schema)).count() == 0


def test_far_cells_are_not_sent(spark, monkeypatch):
    """Clusters on the axes: every query finds its best near by, so cells of other clusters are pruned before the shuffle."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in 50 * np.eye(8)[i % 8] + rng.normal(size=8) * 0.1]) for i in range(1600)] + [(1600 + i, [0.0] * 7 + [50.0]) for i in range(3)]
    rows += [(50, rows[50][1])] * 40  # a row that repeats counts once
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    sent, make = [], spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, schema=None, **k: (sent.append(len(data)) if schema == "g int, cell int" else None, make(data, schema, **k))[1])
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in C.top_k(df, block_rows=40, group_rows=1).collect()}
    assert got == brute(rows[:1603]) and 0 < sent[0] < 0.6 * 33 * 42


# ---- mixing


def test_exponent_meets_its_target(spark):
    t = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, tokens bigint")
    p = np.array([1000, 100, 10]) / 1110
    a = mixing.bisect_exponent(t, 4.0, None)
    assert abs((100.0) ** (1 - a) - 4.0) < 1e-6
    h = mixing.bisect_exponent(t, None, 0.9)
    w = p**h / (p**h).sum()
    assert abs(-(w * np.log(w)).sum() - 0.9) < 1e-6
    assert mixing.bisect_exponent(t, 1000.0, None) == 0 and mixing.bisect_exponent(t, None, 0.01) == 1 and mixing.bisect_exponent(t, None, 5.0) == 0
    assert mixing.bisect_exponent(t, 4.0, 0.9) == max(a, h)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tokens int, epoch int"


def test_mixture(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "big", 0, 1, 1) for i in range(400)] + [(1000 + i, "w " * 3, "en", None, 0, 1, 1) for i in range(40)] + [(None, None, None, "tiny", None, None, None), (1000, "w w w", "en", None, 0, 1, 1)]
    df = spark.createDataFrame(rows, DOCS)
    placed = mixing.mix(df, max_repetition=3.0, block_tokens=200).collect()
    copies = {}
    for r in placed:
        copies.setdefault((r.doc_id, r.source), []).append(r.epoch)
    assert len(copies) == 441 and all(min(e) == 0 for e in copies.values())
    assert {len(e) for k, e in copies.items() if k[1] == "big"} == {1} and max(len(e) for k, e in copies.items() if k[1] == "tiny") == 3
    for b in {r.block_id for r in placed}:
        own = [r for r in placed if r.block_id == b]
        assert sorted(r.block_pos for r in own) == list(range(len(own)))
    out = mixing.mix_documents(df, max_repetition=3.0).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    want = {}
    for (i, _), e in copies.items():
        want[i] = len(e)
    assert {r.doc_id: r.n for r in out} == want
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix_documents(df.limit(0)).count() == 0


def test_ties_at_the_cut_are_counted_off(spark):
    """Rows of one id and size, or without an id, come as often as the mixture without texts holds them."""
    rows = [(None, f"a b c{i % 2}", "en", "small", i, 1, 1) for i in range(9)] + [(7, "x y", "en", "small", 0, 1, 1)] * 4
    rows += [(100 + i, "w " * 5, "en", "big", 0, 1, 1) for i in range(60)] + [(50 + i, "u v", "de", "mid", 0, 1, 1) for i in range(12)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for how in ({"max_repetition": 2.0}, {"max_repetition": 3.0}, {"budget": 700.0}, {"budget": 55.0}):
        want = {(str(r.doc_id), r.source): r["count"] for r in mixing.mix(df, **how).groupBy("doc_id", "source").count().collect()}
        got = {(str(r.doc_id), r.source): r["count"] for r in mixing.mix_documents(df, **how).groupBy("doc_id", "source").count().collect()}
        assert got == want, how


# ---- revisits

CAPTURES = "record_id bigint, url string, ts bigint, kind string, headers map<string,string>, payload_id bigint, payload_digest string"


def test_revisit_cases(spark):
    rows = [
        (1, "http://www.Ex.org/a/?b=2&a=1&utm_x=9#f", 100, "response", {"ETag": '"v1"', "Content-Type": "t", "Date": "d1"}, 11, "p1"),
        (2, "https://ex.org:443/a?a=1&b=2", 200, "revisit", {"etag": 'W/"v1"', "Date": "d2", "Content-Type": "evil"}, None, None),
        (3, "https://ex.org/a?a=1&b=2", 90_000, "response", {"ETag": '"v2"'}, 13, "p3"),
        (4, "https://ex.org/a?a=1&b=2", 90_000, "revisit", {"ETAG": '"v1"'}, None, None),
        (5, "https://ex.org/a?a=1&b=2", 400_000, "revisit", {"etag": '"v1"'}, None, None),
        (6, "https://ex.org/a?a=1&b=2", 400_001, "revisit", None, None, None),
        (7, "https://ex.org/none", 5, "revisit", {}, None, None),
        (8, None, 5, "response", {}, 18, "p8"),
        (9, None, 6, "revisit", {}, None, None),
    ]
    got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, CAPTURES)).collect()}
    assert {k: (r.outcome, r.response_id) for k, r in got.items()} == {
        1: ("full", None), 2: ("resolved", 1), 3: ("full", None), 4: ("resolved", 1), 5: ("validator_mismatch", None), 6: ("unchecked", 3), 7: ("no_earlier_response", None), 8: ("full", None), 9: ("no_earlier_response", None),
    }
    assert got[2].headers == {"etag": 'W/"v1"', "content-type": "t", "date": "d2"} and got[2].payload_id == 11 and got[2].canonical_url == "ex.org/a?a=1&b=2"
    assert revisits.resolve(spark.createDataFrame([], CAPTURES)).count() == 0


def test_urls_without_scheme_ports_repeats_and_ties(spark):
    rows = [
        (1, "example.com/a", 10, "response", {"etag": "a"}, 1, "p1"),
        (2, "other.org/b", 20, "revisit", {}, None, None),
        (3, "other.org/b", 5, "response", {}, 3, "p3"),
        (4, "", 5, "response", {}, 4, "p4"),
        (5, "", 50, "revisit", {}, None, None),
        (6, "http://h.org:443/x", 5, "response", {}, 6, "p6"),
        (7, "https://h.org:443/x", 50, "revisit", {}, None, None),
        (8, "http://h.org:80/y", 5, "response", {}, 8, "p8"),
        (9, "http://h.org/y", 5, "response", {}, 9, "p9"),
        (10, "http://h.org/y", 5, "revisit", {}, None, None),
        (11, "http://h.org/y", 6, "revisit", {}, None, None),
        (11, "http://h.org/y", 6, "revisit", {}, None, None),
    ]
    out = revisits.resolve(spark.createDataFrame(rows, CAPTURES).withColumn("slice", F.lit("x")).withColumn("here", F.lit(1))).collect()
    assert len(out) == 12 and sum(r.record_id == 11 and r.response_id == 9 for r in out) == 2
    got = {r.record_id: (r.outcome, r.response_id) for r in out}
    assert got[2] == ("unchecked", 3) and got[5] == ("no_earlier_response", None) and got[7] == ("no_earlier_response", None) and got[10] == ("no_earlier_response", None)


def test_slices_do_not_matter(spark):
    caps = revisits.captures_of(table(spark, "/root/testdata/sf0.001", "pages"))
    a = {tuple(map(str, r)) for r in revisits.resolve(caps, 86_400).collect()}
    assert a == {tuple(map(str, r)) for r in revisits.resolve(caps, 10**9).collect()} == {tuple(map(str, r)) for r in revisits.resolve(caps, 600).collect()}
