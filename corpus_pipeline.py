"""Documents to training sequences in five stages: line-first quality rules, line-CRF quality,
SimHash near-duplicates, temperature mixing of sources and best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import line_crf, mixing, packing, quality_rules, simhash
from siftwell.llm.common import discard, materialize, table, temporary


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: failing lines go, and so do the documents that it rejects."""
    return quality_rules.clean_documents(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, fitted on the labelled source documents (the stage before has taken nearly all of one
    class): those scored below 0.3 go."""
    return line_crf.keep_good(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the document with the smallest doc_id of each group stays."""
    return simhash.dedup_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: every document once at least, small sources repeated towards their weights."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("near-duplicates", near_dedup_stage),
    ("source mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier, XXH64 fingerprints and tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's scratch tables, and its predecessor's rows, go once it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        with temporary(spark) as keep:
            docs, path = materialize(stage(spark, docs, sf_dir), f"stage{k}")
            keep.append(path)
        if before:
            discard(spark, before)
        before = path
    return docs
