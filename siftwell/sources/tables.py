"""Reading the input tables: declared schemas, required columns, nulls of text as ""."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.contracts import need_columns

ARTICLES = "article_id bigint, title string, body string"
LABELLED = "query_id bigint, query_text string, ground_truth string"
QUERIES = "query_id bigint, query_text string"


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than the cluster has cores (a small file, one row group) dealt out to all of
    them; any larger scan as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_feather(spark: SparkSession, path: str, parquet: str) -> DataFrame:
    """A Feather file, converted once: batches stream into one Parquet file that Spark then scans. The file
    is a local one of the driver (Spark has no such source); ``parquet`` may be any store Spark writes to."""
    import pyarrow as pa

    with pa.memory_map(path) as source:
        reader = pa.ipc.open_file(source)
        for k in range(reader.num_record_batches):
            batch = pa.Table.from_batches([reader.get_batch(k)])
            spark.createDataFrame(batch).write.mode("append" if k else "overwrite").parquet(parquet)
    return spark.read.parquet(parquet)


def _load(df: DataFrame, schema: str, name: str) -> DataFrame:
    fields = [f.split(" ") for f in schema.split(", ")]
    need_columns(df, [c for c, _ in fields], name)
    return df.select(*[F.col(c).cast("bigint").alias(c) if kind == "bigint" else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c, kind in fields])


def load_articles(df: DataFrame) -> DataFrame:
    return _load(df, ARTICLES, "articles")


def load_labelled(df: DataFrame) -> DataFrame:
    return _load(df, LABELLED, "labelled queries")


def load_queries(df: DataFrame) -> DataFrame:
    return _load(df, QUERIES, "queries")


def read_scores(spark: SparkSession, path: str, sources: Sequence[str] | None = None, split: str | None = None) -> DataFrame:
    """The score store (partitioned by source and split); filters prune partitions."""
    df = spark.read.parquet(path)
    if sources is not None:
        df = df.where(F.col("source").isin(*sources))
    return df if split is None else df.where(F.col("split") == split)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a declared schema: ids and lists stay what they are declared as."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "query_id bigint, answer string").select("query_id", F.coalesce("answer", F.lit("")).alias("answer"))


def candidate_lists(candidates: DataFrame) -> DataFrame:
    """(query_id, article_ids): candidates in rank order."""
    return candidates.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "article_id"))), lambda x: x["article_id"]).alias("article_ids"))


def missing_folds(spark: SparkSession, path: str, folds: Sequence[int]) -> list[int]:
    """Folds without a finished partition: what a resumed run still has to do."""
    try:
        done = {r.fold for r in spark.read.parquet(path).select("fold").distinct().collect()}
    except Exception as gone:  # the table does not exist yet
        if "PATH_NOT_FOUND" not in str(gone) and "UNABLE_TO_INFER_SCHEMA" not in str(gone):
            raise
        done = set()
    return [f for f in folds if f not in done]


def run_catalogue(spark: SparkSession, pattern: str, schema: str, metric: str = "map") -> DataFrame:
    """All runs that a path pattern finds, with their file, best metric first; incomplete rows (no metric) go."""
    runs = spark.read.option("header", True).schema(schema).csv(pattern).withColumn("file", F.input_file_name())
    return runs.where(F.col(metric).isNotNull()).orderBy(F.col(metric).desc())


def union_runs(runs: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL of run tables; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


