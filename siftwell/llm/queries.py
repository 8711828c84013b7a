"""The queries of the corpus operators: each applies one to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import chat, cover_tree, html_text, line_crf, mixing, packing, quality_rules, revisits, simhash, toxicity
from siftwell.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.resolve_pages(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string")
    own = table(spark, sf_dir, "conversations").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in control.schema.fields])
    return chat.digest_conversations(own.unionByName(control))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_cover_tree_top_k": op2_cover_tree_top_k,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_chat_template": op5_chat_template,
    "op6_html_text": op6_html_text,
    "op7_quality_rules": op7_quality_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_mix_sources": op9_mix_sources,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {"op2_cover_tree_top_k": cover_tree.TOP_K_SQL, "op3_warc_revisits": revisits.REVISITS_SQL, "op5_chat_template": chat.CHAT_SQL, "op9_mix_sources": mixing.MIX_SQL}
