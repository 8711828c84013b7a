"""Writing tables, answers, manifests and logs; small sidecar files go through Spark's file systems, so any
store that Spark writes to will do."""

from __future__ import annotations

import datetime
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.rank import keep_latest


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str, append: bool = False) -> None:
    fs, where = _fs(spark, path)
    old = read_text(spark, path) if append and fs.exists(where) else ""
    out = fs.create(where, True)
    try:
        out.write(bytearray((old + text).encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def write_json(spark: SparkSession, path: str, payload: object) -> None:
    write_text(spark, path, json.dumps(payload, ensure_ascii=False, sort_keys=True, indent=2))


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(read_text(spark, path))


def write_scores(scores: DataFrame, path: str) -> None:
    """Long scores, partitioned by source and split; only the written partitions are replaced."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "split").parquet(path)


def write_fold(scores: DataFrame, path: str) -> None:
    """One finished fold: its partition is replaced, others stay (resumable progress)."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold").parquet(path)


def write_answers(answers: DataFrame, path: str) -> None:
    """One CSV file with a header, in query order (an answer table is small: one row a query)."""
    answers.coalesce(1).sortWithinPartitions("query_id").write.mode("overwrite").option("header", True).csv(path)


def save_index(postings: DataFrame, path: str, meta: dict, key: str = "term", parts: int = 16) -> None:
    """A postings table, rows of a key together, with its settings beside it."""
    postings.repartition(parts, key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/postings")
    write_json(postings.sparkSession, f"{path}/meta.json", meta)


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/postings"), read_json(spark, f"{path}/meta.json")


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: str = "created_at") -> DataFrame:
    """Old and new rows, the latest of each key."""
    both = new if old is None else old.unionByName(new, allowMissingColumns=True)
    return keep_latest(both, keys, order)


def content_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:16]


def config_hash(section: object) -> str:
    return content_hash(json.dumps(section, sort_keys=True, ensure_ascii=False).encode())


def table_hash(df: DataFrame) -> str:
    """An order-free hash of a table's rows, for manifests of inputs in any store."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return content_hash(f"{row.n}:{row.h}".encode())


def manifest(stage: str, schema_version: int, seed: int, config: str, inputs: dict[str, str], **extra: object) -> dict:
    import pyspark

    now = datetime.datetime.now(datetime.timezone.utc).isoformat()
    return {"stage": stage, "schema_version": schema_version, "seed": seed, "config_hash": config, "inputs": inputs, "created_at": now, "versions": {"pyspark": pyspark.__version__}} | extra


def write_manifest(spark: SparkSession, path: str, body: dict) -> None:
    write_json(spark, f"{path}/manifest.json", body)


def is_fresh(spark: SparkSession, path: str, schema_version: int, config: str, inputs: dict[str, str], seed: int, outputs: tuple[str, ...] = ()) -> bool:
    """Whether a stage's outputs exist and were made by the same settings, seed and inputs."""
    if not exists(spark, f"{path}/manifest.json") or not all(exists(spark, f"{path}/{o}") for o in outputs):
        return False
    old = read_json(spark, f"{path}/manifest.json")
    return all(old.get(k) == v for k, v in (("schema_version", schema_version), ("config_hash", config), ("inputs", inputs), ("seed", seed)))


def log_access(spark: SparkSession, path: str, what: str, results: dict, budget: int = 3) -> int:
    """Appends a look at the held-out queries to a JSON-lines log; raises once the budget is spent."""
    used = len([x for x in read_text(spark, path).splitlines() if x.strip()]) if exists(spark, path) else 0
    if used >= budget:
        raise PermissionError(f"the held-out queries were looked at {used} times")
    write_text(spark, path, json.dumps({"what": what, "results": results, "n": used + 1}, sort_keys=True) + "\n", append=True)
    return budget - used - 1


def prune(spark: SparkSession, root: str, keep: set[str]) -> list[str]:
    """Deletes the sub-folders of ``root`` whose names are not in ``keep``."""
    fs, where = _fs(spark, root)
    gone = []
    for status in fs.listStatus(where) if fs.exists(where) else []:
        name = status.getPath().getName()
        if status.isDirectory() and name not in keep:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
