import pytest
from pyspark.sql import functions as F

from siftwell.functions import perturb
from siftwell.functions import text as T
from siftwell.functions.html import page_text
from siftwell.operators import corpus


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_page_text_keeps_and_drops():
    assert page_text("<p>one<script>x()</script> two</p><label>three</label><table><tr><td>4</td></tr></table>") == "one two three 4"
    assert page_text("a\xa0b\n c") == "a b c"
    assert page_text("") == "" and page_text(None) == ""


def test_links_are_distinct_in_first_order(spark):
    html = '<a href="https://x.org/articles/101">a</a><a href="/articles/202">b</a><a href="/articles/101">c</a>'
    assert one(spark, html, T.article_links("x")) == [101, 202]
    assert one(spark, None, T.article_links("x")) == []


def test_tokens_filter_and_substitute(spark):
    got = one(spark, "Where is <MONEY>, a-b <ID> и в что word!", T.tokens("x", placeholders=T.PLACEHOLDERS))
    assert got == ["where", "is", "деньги", "a-b", "word"]
    assert one(spark, None, T.tokens("x")) == []


def test_basic_letters_split_accents(spark):
    assert one(spark, "été naïve ок", T.tokens("x", letters=T.BASIC_LETTERS)) == ["na", "ve", "ок"]


def test_lemma_map_runs_before_stop_words(spark):
    lemma = F.create_map(F.lit("cats"), F.lit("cat"), F.lit("went"), F.lit("и"))
    assert one(spark, "cats went", T.tokens("x", lemma=lemma)) == ["cat"]


@pytest.mark.parametrize("n,size,overlap,most", [(10, 4, 1, None), (100, 10, 2, 3), (0, 4, 1, None), (4, 4, 1, 5), (5, 4, 3, None)])
def test_windows_match_the_plain_loop(spark, n, size, overlap, most):
    words = [f"w{i}" for i in range(n)]
    want, at = [], 0
    while at < n:
        want.append(words[at : at + size])
        if at + size >= n or (most and len(want) == most):
            break
        at += size - overlap
    assert one(spark, words, T.word_windows(F.col("x"), size, overlap, most), "array<string>") == want


def test_window_arguments():
    with pytest.raises(ValueError):
        T.check_window(4, 4)


def test_chunks_of_empty_bodies(spark):
    rows = spark.createDataFrame([(1, "T", "a b"), (2, "T", ""), (3, "", ""), (4, None, None)], "article_id bigint, title string, body string")
    got = {r.article_id: r.text for r in corpus.chunk_table(corpus.corpus(rows)).collect()}
    assert got == {1: "T. a b", 2: "T", 3: " ", 4: " "}


def test_char_ngrams_are_padded(spark):
    assert one(spark, "ab", T.word_ngrams(F.col("x"))) == [" ab", "ab ", " ab "]
    assert one(spark, "a", T.word_ngrams(F.col("x"))) == [" a "]


def test_hashing_embedding_is_unit_or_zero(spark):
    v = one(spark, "red red blue", T.hashing_embedding("x"))
    assert abs(sum(x * x for x in v) - 1) < 1e-12 and len(v) == 64
    assert set(one(spark, "", T.hashing_embedding("x"))) == {0.0}


def test_variants_are_deterministic(spark):
    q = spark.createDataFrame([(1, "Добрый день прекрасная погода 12,5"), (2, ""), (3, None)], "query_id bigint, query_text string")
    a = {(r.query_id, r.variant): r.query_text for r in perturb.variants(q).collect()}
    b = {(r.query_id, r.variant): r.query_text for r in perturb.variants(q.repartition(3)).collect()}
    assert a == b and len(a) == 30
    assert a[1, "mask_entities"].endswith("<NUMBER>") and len(a[1, "typo_delete"]) == len(a[1, "original"]) - 1
    assert a[2, "typo_two"] == "" and a[1, "case_punct"].startswith("!!! дОБРЫЙ")


def test_random_variants_change_one_content_word(spark):
    texts = ["the small harbour was full of fishing boats", "прекрасная погода на выходных", "a b 12 <URL>", "", "ßßßßß Straße", "harbour"]
    q = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 20)], "query_id bigint, query_text string")
    seen = set()
    for r in perturb.variants(q, perturb.RANDOM).collect():
        old, new = texts[r.query_id % len(texts)], r.query_text
        a, b = old.split(" "), new.split(" ")
        if r.variant == "case_punct":
            assert new[4:-4].lower() == old.lower()
            continue
        content = [w for w in a if len(w) >= 5 and w.isalpha() and w not in T.STOP_WORDS]
        if not content:
            assert new == old
            continue
        if r.variant == "drop_content":
            assert [w for w in content if a.count(w) > b.count(w)] and len(b) == max(1, len(a) - 1)
            continue
        changed = [(x, y) for x, y in zip(a, b) if x != y]
        assert len(a) == len(b) and len(changed) <= (2 if r.variant == "typo_two" else 1)
        for x, y in changed:
            seen.add(r.variant)
            assert x in content and x[0] == y[0]
            if r.variant == "typo_delete":
                assert len(y) == len(x) - 1
            elif r.variant == "typo_swap":
                assert sorted(x) == sorted(y)
            elif r.variant == "typo_keyboard":
                assert len(x) == len(y) and sum(c != d for c, d in zip(x, y)) == 1
    assert seen == {"typo_delete", "typo_swap", "typo_keyboard", "typo_two"}


def test_containment_labels(spark):
    docs = spark.createDataFrame([(1, "x one two three four five y"), (2, "one two three four"), (3, "axone two three four fiveb"), (4, None), (5, "")], "doc_id bigint, text string")
    passages = spark.createDataFrame([(7, "one two three four five"), (8, "two three"), (9, None), (10, "")], "item_id bigint, text string")
    got = {tuple(r) for r in corpus.containment_labels(docs, passages).collect()}
    assert got == {(7, 1), (7, 3), (8, 1), (8, 2), (8, 3)}
    assert {tuple(r) for r in corpus.containment_labels(docs, passages, broadcast_rows=0).collect()} == got


def test_label_strings(spark):
    q = spark.createDataFrame([(1, "5 7 5"), (2, " "), (3, None)], "query_id bigint, ground_truth string")
    assert {tuple(r) for r in corpus.parse_labels(q).collect()} == {(1, 5), (1, 7)}
