"""Corpus, chunk and label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as T


def corpus(articles: DataFrame, ident: str = "article_id", title: str | Column = "title", body: str | Column = "body") -> DataFrame:
    """(article_id, title, clean_text) with nulls as "" and white space folded."""
    clean = lambda c: T.collapse_blanks(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return articles.select(F.col(ident).cast("bigint").alias("article_id"), clean(title).alias("title"), clean(body).alias("clean_text"))


def first_line(text: str = "text") -> Column:
    return F.substring_index(F.coalesce(F.col(text), F.lit("")), "\n", 1)


def after_first_line(text: str = "text") -> Column:
    full = F.coalesce(F.col(text), F.lit(""))
    at = F.instr(full, "\n")
    return F.when(at > 0, full.substr(at + 1, F.length(full))).otherwise("")


def from_documents(documents: DataFrame) -> DataFrame:
    """Plain documents as articles: the first line is the title, the rest the body."""
    return corpus(documents, "doc_id", first_line(), after_first_line())


def chunk_table(articles: DataFrame, size: int = 400, overlap: int = 100, most: int | None = 40, prefix: bool = True, at_least_one: bool = True) -> DataFrame:
    """(article_id, chunk_id, text). ``most`` chunks an article at most: words after them are in none; None
    keeps whole texts. ``at_least_one``: an article without words still has one chunk, its title or a blank."""
    made = T.chunks("clean_text", "title", size, overlap, most, prefix)
    if at_least_one:
        made = T.bind(made, lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(F.lit(" "))))
    return articles.select("article_id", F.posexplode(made).alias("chunk_id", "text"))


def parse_labels(queries: DataFrame, ident: str = "query_id", labels: str = "ground_truth") -> DataFrame:
    """(query_id, article_id): distinct ids of a space-joined label string; blank strings give no row."""
    return queries.select(F.col(ident).cast("bigint").alias("query_id"), F.explode(F.array_distinct(T.blank_words(labels))).alias("a")).select("query_id", F.col("a").cast("bigint").alias("article_id"))


def known_only(labels: DataFrame, articles: DataFrame) -> DataFrame:
    return labels.join(articles.select("article_id"), "article_id", "left_semi")


def containment_labels(documents: DataFrame, passages: DataFrame, width: int = 3, broadcast_rows: int = 200_000) -> DataFrame:
    """(query_id, article_id): documents that contain a passage (item_id, text) literally.

    The inner words of a contained passage are words of the document, so its second to fourth word form a
    shingle of the document too: shingles are matched by hash (an equi-join; the passages are broadcast
    only while they are few), and the text comparison runs on matches alone. Passages of fewer than five
    words have no such shingle and are compared directly, document by document."""
    words = T.blank_words("text")
    named = passages.where(F.col("text").isNotNull() & (F.col("text") != "")).select(F.col("item_id").cast("bigint").alias("query_id"), F.col("text").alias("passage"), words.alias("w"))
    key = F.xxhash64(F.array_join(F.slice(F.col("w"), 2, width), " "))
    long = named.where(F.size("w") >= width + 2).select("query_id", "passage", key.alias("key"))
    short = named.where(F.size("w") < width + 2).select("query_id", "passage")
    doc = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("article_id"), "text")
    # The hash keys of a document's shingles; its text goes on only in rows that match.
    shingle = lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, width), " ")))).otherwise(F.array().cast("array<bigint>"))
    keyed = doc.select("article_id", "text", F.explode(F.array_distinct(T.bind(words, shingle))).alias("key"))
    side = F.broadcast(long) if long.limit(broadcast_rows + 1).count() <= broadcast_rows else long
    hits = keyed.join(side, "key").where(F.contains("text", "passage")).select("query_id", "article_id")
    if not short.isEmpty():
        hits = hits.unionByName(doc.join(short, F.contains("text", "passage")).select("query_id", "article_id"))
    return hits.distinct()


def profile(articles: DataFrame) -> DataFrame:
    """One row: articles, empty share, median and largest text length."""
    n = F.length("clean_text")
    return articles.agg(
        F.count("*").alias("n_articles"),
        F.round(F.avg((n == 0).cast("double")), 6).alias("empty_share"),
        F.percentile(n, F.lit(0.5)).alias("median_chars"),
        F.max(n).cast("bigint").alias("max_chars"),
    )
