"""Query-passage pairs from relevance judgements, and the joins around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import canonical_id
from tessera.functions.text import is_valid_text, title_or_none


def last_per_key(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """One row per non-null key with the values of its last row by order; combined before the shuffle."""
    last = F.max_by(F.struct(*values), order).alias("v")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, "v.*")


def graded(qrels: DataFrame, grade: int = 1) -> DataFrame:
    """(query_id, doc_id, ord) of the judgements with exactly this grade; higher grades are left out."""
    return qrels.where(F.col("score") == grade).select(canonical_id("query-id").alias("query_id"), canonical_id("corpus-id").alias("doc_id"), "ord")


def build_pairs(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, *, grade: int = 1) -> DataFrame:
    """Training pairs: query_id, query_text, positive_id, positive_title, positive_text, first_ord.

    Judgements of the given grade count. Each query has one positive: its last
    judgement by ord. Repeated ids in queries and corpus: the last row wins.
    The one positive is chosen before it is looked up, so a query whose last
    positive is missing has no pair even if an earlier one exists. Titles that
    are empty or null read 'none'. first_ord, the place of the query's first
    judgement, gives the order of pairs. Null, blank and damaged ids match
    nothing. Empty tables give no pairs.
    """
    chosen = (
        graded(qrels, grade)
        .where("query_id is not null")
        .groupBy("query_id")
        .agg(F.max_by(F.struct("doc_id"), "ord").alias("d"), F.min("ord").alias("first_ord"))
        .select("query_id", F.col("d.doc_id").alias("positive_id"), "first_ord")
        .where("positive_id is not null")
    )
    q = _rows_of(queries, chosen.select("query_id"), "query_id", "text").withColumnRenamed("text", "query_text")
    d = _rows_of(corpus, chosen.select("positive_id").distinct(), "positive_id", "title", "text")
    d = d.select("positive_id", title_or_none("title").alias("positive_title"), F.col("text").alias("positive_text"))
    return chosen.join(q, "query_id").join(d, "positive_id").select("query_id", "query_text", "positive_id", "positive_title", "positive_text", "first_ord")


def _rows_of(df: DataFrame, ids: DataFrame, key: str, *values: str) -> DataFrame:
    """The last row of df of each of the ids, by canonical id: rows that are not asked for are left before anything of them is shuffled by key."""
    return last_per_key(df.withColumn(key, canonical_id("_id")).join(ids, key, "left_semi"), key, "ord", *values)


def referenced_corpus(corpus: DataFrame, qrels: DataFrame, grade: int = 1) -> DataFrame:
    """The rows of corpus that a judgement of the grade refers to."""
    ids = graded(qrels, grade).select(F.col("doc_id").alias("_ref")).where("_ref is not null").distinct()
    return corpus.join(ids, canonical_id(corpus["_id"]) == ids["_ref"], "left_semi")


def queries_with_positives(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries for which some judgement has a grade above 0."""
    ids = qrels.where("score > 0").select(canonical_id("query-id").alias("_ref")).where("_ref is not null").distinct()
    return queries.join(ids, canonical_id(queries["_id"]) == ids["_ref"], "left_semi")


def valid_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text is there and not blank."""
    return df.where(is_valid_text(text))


def zip_aligned(left: DataFrame, right: DataFrame, position: str) -> DataFrame:
    """Two tables that belong together row by row, joined on an explicit position."""
    return left.join(right, position)


def exclude_positives(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Hits (query_id, doc_id, ...) that no judgement calls relevant: hard negatives (an extension)."""
    known = qrels.where("score > 0").select(canonical_id("query-id").alias("query_id"), canonical_id("corpus-id").cast("bigint").alias("doc_id")).distinct()
    return run.join(known, ["query_id", "doc_id"], "left_anti")
