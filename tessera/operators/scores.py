"""Aggregates over task scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mean_score(results: DataFrame, score: str = "main_score") -> DataFrame:
    """(mean): unweighted mean over tasks."""
    return results.agg(F.avg(score).alias("mean"))


def running_mean(results: DataFrame, order: str, score: str = "main_score") -> DataFrame:
    """results with running_mean, the mean of scores up to each task. One row per task, so one partition is enough."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return results.withColumn("running_mean", F.avg(score).over(w))


def throughput(df: DataFrame, tokens: str, seconds: float, world: int) -> DataFrame:
    """(tokens, per_second): tokens of all workers, and per second and worker."""
    return df.agg(F.sum(tokens).alias("tokens"), (F.sum(tokens) / (F.lit(float(seconds)) * world)).alias("per_second"))
