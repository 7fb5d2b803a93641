"""Token ids of texts by a pluggable tokenizer, truncated or with an end token."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_words(c: Column) -> Column:
    """Words at white space, the built-in stand-in for a tokenizer."""
    return F.filter(F.split(c, r"[ \t\n\r\f]+"), lambda x: x != "")


def word_ids(c: Column, vocabulary: int = 30_000) -> Column:
    """A stable id in [0, vocabulary) for each word of c; null texts have none."""
    ids = F.transform(split_words(c), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(vocabulary)).cast("int"))
    return F.coalesce(ids, F.array().cast("array<int>"))


def truncated(ids: Column, most: int) -> Column:
    """The first `most` ids."""
    return F.slice(ids, 1, most)


def with_end(ids: Column, end: int) -> Column:
    """The ids and an end token; nothing is truncated."""
    return F.concat(ids, F.array(F.lit(end)))


def tokenize(df: DataFrame, encode: Callable[[list[str]], list[list[int]]], *, key: str, text: str, out: str = "input_ids") -> DataFrame:
    """(key, out) by any batch tokenizer, in Arrow batches; null texts are tokenized as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), F.col("ids").alias(out))


def tokenized_examples(pairs: DataFrame, *, max_query: int, max_passage: int, query_text: Column, passage_text: Column) -> DataFrame:
    """query_text, pos_text, their ids and lengths, pos_ids and total_len of training pairs."""
    t = pairs.select("query_id", "positive_id", query_text.alias("query_text"), passage_text.alias("pos_text"))
    t = t.withColumn("query_token_ids", truncated(word_ids(F.col("query_text")), max_query)).withColumn("pos_token_ids", truncated(word_ids(F.col("pos_text")), max_passage))
    return t.select(
        "query_id",
        F.col("positive_id").try_cast("bigint").alias("pos_ids"),
        "query_text",
        "pos_text",
        "query_token_ids",
        "pos_token_ids",
        F.size("query_token_ids").alias("query_len"),
        F.size("pos_token_ids").alias("pos_len"),
        (F.size("query_token_ids") + F.size("pos_token_ids")).alias("total_len"),
    )
