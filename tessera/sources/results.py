"""Sinks and sources of mining records, task results and training logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a mining record.
RECORD = "query_id string, query string, doc_ids array<bigint>, scores array<double>"

#: Result formats and the Spark format and options each is kept in.
FORMATS = {
    "jsonl": ("json", {}),
    "parquet": ("parquet", {"compression": "zstd"}),
}
#: Formats that callers may know from elsewhere and that are not kept here, with the reason.
REFUSED = {
    "hdf5": "there is no library for it here; parquet holds the same records in columns",
    "pickle": "loading a pickle runs code from the file; parquet holds the same records",
    "npz": "it has one file per query; parquet holds all queries in one table",
}


def _format(name: str) -> tuple[str, dict[str, str]]:
    if name in REFUSED:
        raise ValueError(f"Format {name} is not supported: {REFUSED[name]}")
    try:
        return FORMATS[name]
    except KeyError:
        raise ValueError(f"Unknown format: {name}; known are {', '.join(sorted(FORMATS))}") from None


def save_records(df: DataFrame, path: str, fmt: str = "jsonl") -> None:
    """Write mining records; an unknown or refused format is a ValueError."""
    spark_format, options = _format(fmt)
    df.select(F.col("query_id").cast("string").alias("query_id"), "query", "doc_ids", "scores").write.mode("overwrite").format(spark_format).options(**options).save(path)


def load_records(spark: SparkSession, path: str, fmt: str = "jsonl") -> DataFrame:
    """Read mining records back, with their schema; query ids are strings."""
    spark_format, _ = _format(fmt)
    return spark.read.schema(RECORD).format(spark_format).load(path)


def load_task_results(spark: SparkSession, path: str) -> DataFrame:
    """(task, main_score, task_type, time, split) of one JSON object keyed by task; time stays a string.

    Of a task that is there with several splits, each split has an object of its own (a line of the file)."""
    kind = "map<string, struct<main_score: double, task_type: string, time: string, split: string>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n(?=\{)")).alias("value")).select(F.from_json("value", kind).alias("m"))
    return whole.select(F.explode("m").alias("task", "r")).select("task", "r.*")


def save_task_results(df: DataFrame, path: str) -> None:
    """One JSON object keyed by task, a line for each split. A few rows by nature (one per task and split)."""
    text = df.groupBy("split").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("task", F.struct("main_score", "task_type", "time", "split"))))).alias("value")).select("value")
    text.coalesce(1).write.mode("overwrite").text(path)


def collect_task_results(df: DataFrame) -> DataFrame:
    """Scores keyed by task and split, time formatted with two decimals; several splits stay apart."""
    return df.select("task", "split", "main_score", "task_type", F.format_string("%.2f", F.col("seconds").cast("double")).alias("time"))


def append_log(spark: SparkSession, path: str, params: dict, steps: dict[int, float]) -> None:
    """Add steps (step, avg_loss) of a run to its log, with the run's parameters as JSON."""
    rows = [(json.dumps(params, sort_keys=True), int(s), float(v)) for s, v in steps.items()]
    spark.createDataFrame(rows, "train_params string, step bigint, avg_loss double").coalesce(1).write.mode("append").parquet(path)


def load_log(spark: SparkSession, path: str) -> DataFrame:
    """(train_params, step, avg_loss)."""
    return spark.read.schema("train_params string, step bigint, avg_loss double").parquet(path)
