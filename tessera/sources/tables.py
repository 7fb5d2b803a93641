"""Reading the project's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_dataset(spark: SparkSession, texts: Sequence[str | None]) -> DataFrame:
    """(pos bigint, text string): a few given texts as a table, with their places."""
    return spark.createDataFrame(list(enumerate(texts)), "pos bigint, text string")
