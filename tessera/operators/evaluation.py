"""Evaluation of retrieval end to end: encode, search, score, and a benchmark over several tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ids import canonical_id
from tessera.operators.encode import Encoder, encode_texts
from tessera.operators.metrics import K_VALUES, averaged, per_query
from tessera.operators.pairs import last_per_key, queries_with_positives
from tessera.operators.search import drop_self, top_k
from tessera.session import cut


def run_of(queries: DataFrame, corpus: DataFrame, encoder: Encoder, k: int = 50, *, query_text: str = "text", corpus_text: str = "text", pool: str = "last") -> DataFrame:
    """(qid, did, score, rank): the k nearest texts of each query, itself aside, both encoded by the encoder.

    Ids are the numbers that _id spells; rows without one take no part, and of an id the last row by ord counts.
    """

    def vectors(df: DataFrame, text: str) -> DataFrame:
        numbered = df.select(canonical_id("_id").try_cast("bigint").alias("vec_id"), "ord", F.col(text).alias("text"))
        return encode_texts(last_per_key(numbered, "vec_id", "ord", "text"), encoder, key="vec_id", text="text", pool=pool)

    return drop_self(top_k(vectors(queries, query_text), vectors(corpus, corpus_text), k + 1), k)


def judgements(qrels: DataFrame) -> DataFrame:
    """(qid, did, rel): the highest grade of each pair judged, by number; rows without an id or grade are left out."""
    ids = qrels.select(canonical_id("query-id").try_cast("bigint").alias("qid"), canonical_id("corpus-id").try_cast("bigint").alias("did"), F.col("score").alias("rel"))
    return ids.where("qid is not null and did is not null and rel is not null").groupBy("qid", "did").agg(F.max("rel").cast("int").alias("rel"))


def evaluate(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, encoder: Encoder, *, ks: Sequence[int] = K_VALUES, pool: str = "last") -> DataFrame:
    """(k, p, recall, mrr, map, ndcg): metrics of an encoder, averaged over the queries that have a judgement above 0."""
    asked = queries_with_positives(queries, qrels)
    return averaged(per_query(run_of(asked, corpus, encoder, max(ks), pool=pool), judgements(qrels), ks))


def benchmark(spark: SparkSession, tasks: Iterable[tuple[str, str, str, Callable[[], DataFrame]]], *, main: str = "ndcg", at: int = 10) -> DataFrame:
    """(task, split, task_type, main_score, seconds): each task (name, split, type, metrics) evaluated in turn, with its time.

    metrics gives a table as evaluate does; the main score is its column `main` at cut-off `at`. A row for each task, by nature few.
    """
    rows = []
    for name, split, kind, metrics in tasks:
        began = time.perf_counter()
        got = cut(metrics()).where(F.col("k") == at).select(main).first()
        rows.append((name, split, kind, None if got is None else float(got[0]), time.perf_counter() - began))
    return spark.createDataFrame(rows, "task string, split string, task_type string, main_score double, seconds double")
