"""Exact cosine search: blocked products with running top k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.vectors import stack_vectors, unit_rows

#: Bytes of query vectors up to which they are broadcast; beyond, they are shuffled to groups of the corpus.
QUERY_BYTES = 16 << 20
#: Scores that are held at a time, and queries that are scored together.
SCORE_CELLS, QUERY_CHUNK = 4 << 20, 1024
#: Bytes of vectors that a group of the corpus is meant for.
GROUP_BYTES = 64 << 20

HITS = "qid bigint, did bigint, score double"


def best_of_slab(qids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the k best columns of each row of scores, ties by id."""
    n, m = scores.shape
    if m > k:
        # everything at least as good as the k-th, so that ties are settled by id below
        cut_at = np.partition(scores, m - k, axis=1)[:, m - k]
        row, col = np.nonzero(scores >= cut_at[:, None])
    else:
        row, col = np.nonzero(np.ones((n, m), bool))
    s = scores[row, col]
    o = np.lexsort((ids[col], -s, row))
    row, col, s = row[o], col[o], s[o]
    rank = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
    keep = rank < k
    return qids[row[keep]], ids[col[keep]], s[keep]


class RunningTop:
    """The k best hits of each query over the slabs seen so far."""

    def __init__(self, k: int):
        self.k, self.held = k, None

    def add(self, q: np.ndarray, d: np.ndarray, s: np.ndarray) -> None:
        if self.held is not None:
            q, d, s = (np.concatenate(x) for x in zip(self.held, (q, d, s)))
        o = np.lexsort((d, -s, q))
        q, d, s = q[o], d[o], s[o]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = rank < self.k
        self.held = (q[keep], d[keep], s[keep])

    def batch(self) -> pa.RecordBatch | None:
        if self.held is None:
            return None
        return pa.RecordBatch.from_arrays([pa.array(x) for x in self.held], ["qid", "did", "score"])


class QueryTops:
    """Running tops of many queries; scores are made for a bounded number of queries and rows at a time."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int):
        self.parts = [(qids[i : i + QUERY_CHUNK], q[i : i + QUERY_CHUNK], RunningTop(k)) for i in range(0, len(qids), QUERY_CHUNK)]

    def add(self, ids: np.ndarray, m: np.ndarray) -> None:
        for qids, q, top in self.parts:
            step = max(1, SCORE_CELLS // len(qids))
            for lo in range(0, len(ids), step):
                top.add(*best_of_slab(qids, ids[lo : lo + step], q @ m[lo : lo + step].T, top.k))

    def batches(self) -> Iterator[pa.RecordBatch]:
        for *_, top in self.parts:
            if (got := top.batch()) is not None:
                yield got


def keyed_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, v): the rows whose id and vector are there."""
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v"))


def extent(vectors: DataFrame) -> tuple[int, int]:
    """(rows, dimensions) of keyed vectors."""
    n, d = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    return n, d


def collected(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of keyed vectors that are known to be few."""
    t = vectors.toArrow().combine_chunks()
    if not t.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    return t["k"].combine_chunks().to_numpy(), unit_rows(stack_vectors(t["v"].combine_chunks()))


def score_groups(rows: DataFrame, k: int, decode=stack_vectors) -> DataFrame:
    """(qid, did, score): the k best hits of each query within each group.

    rows: g bigint, kind int (0: corpus, 1: query), k bigint, v (vector, or code
    for the corpus, c). All queries of a group meet all its corpus rows, which
    are held once; queries stream past them.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts = None, [], []
        for b in batches:
            g, kind = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            edge = np.r_[0, np.flatnonzero((g[1:] != g[:-1]) | (kind[1:] != kind[:-1])) + 1, len(g)]
            for lo, hi in zip(edge, edge[1:]):
                if lo == hi:
                    continue
                c = b.slice(lo, hi - lo)
                if g[lo] != now:
                    now, ids, parts = g[lo], [], []
                key = c.column(2).to_numpy(zero_copy_only=False)
                if kind[lo] == 0:
                    ids.append(key)
                    parts.append(unit_rows(decode(c.column(3))) if decode is stack_vectors else decode(c.column(4)))
                elif ids:
                    if len(ids) > 1:
                        ids, parts = [np.concatenate(ids)], [np.concatenate(parts)]
                    tops = QueryTops(key, unit_rows(stack_vectors(c.column(3))), k)
                    tops.add(ids[0], parts[0])
                    yield from tops.batches()

    return rows.repartition(n, "g").sortWithinPartitions("g", "kind").mapInArrow(scan, HITS)


def merge_top(parts: DataFrame, k: int) -> DataFrame:
    """(qid, did, score, rank): the k best of all partial hits; a window-group limit cuts before the shuffle."""
    w = W.partitionBy("qid").orderBy(F.desc("score"), "did")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, corpus: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", block_bytes: int = QUERY_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(qid, did, score, rank): the k corpus vectors nearest to each query by cosine, ties by id.

    Queries of up to block_bytes are broadcast; each task scores its corpus
    rows, a bounded number of scores at a time, and keeps running tops, so what
    is shuffled is k hits per query and task. More queries never pass through
    the driver: the corpus is dealt to groups of group_bytes, queries are sent to
    each, and a group's k hits of each query are merged. Null ids and vectors take no part,
    a zero vector scores 0 with everything, a corpus smaller than k gives all
    of it, empty tables give no rows.
    """
    spark = corpus.sparkSession
    src, asked = keyed_vectors(corpus, key, vector), keyed_vectors(queries, key, vector)
    n, dim = extent(asked)
    if n * dim * 8 > block_bytes:
        rows, dim = extent(src)
        groups = max(1, -(-rows * dim * 8 // group_bytes))
        dealt = src.select(F.pmod(F.monotonically_increasing_id(), F.lit(groups)).alias("g"), F.lit(0).alias("kind"), "k", "v")
        sent_to = asked.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("g"), F.lit(1).alias("kind"), "k", "v")
        return merge_top(score_groups(dealt.unionByName(sent_to), k), k)
    sent = spark.sparkContext.broadcast(collected(asked))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = QueryTops(*sent.value, k)
        for b in batches:
            if b.num_rows:
                tops.add(b.column(0).to_numpy(zero_copy_only=False), unit_rows(stack_vectors(b.column(1))))
        yield from tops.batches()

    return merge_top(src.mapInArrow(scan, HITS), k)


def drop_self(run: DataFrame, k: int | None = None) -> DataFrame:
    """Hits other than the query itself; ranks close up. Fetch k + 1 first to keep k."""
    out = run.where("qid <> did").drop("rank").withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "did")))
    return out if k is None else out.where(F.col("rank") <= k)


def every_hundredth(df: DataFrame, key: str = "vec_id") -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 100."""
    return df.where(F.col(key) % 100 == 0)


def mining_records(run: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id, query, doc_ids, scores: one record per query, hits by rank. Known positives stay in."""
    hits = run.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "did", "score"))).alias("h"))
    return hits.join(texts, "qid", "left").select(
        F.col("qid").alias("query_id"), "query", F.transform("h", lambda x: x["did"]).alias("doc_ids"), F.transform("h", lambda x: x["score"]).alias("scores")
    )

