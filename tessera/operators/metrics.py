"""Ranking metrics at k: precision, recall, MRR, MAP and nDCG, averaged over queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cut-offs at which metrics are given.
K_VALUES = (1, 3, 5, 10, 20, 50)


def join_judgements(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Every hit of the run with its grade, 0 where there is no judgement."""
    return run.join(qrels, ["qid", "did"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def per_query(run: DataFrame, qrels: DataFrame, ks: Sequence[int] = K_VALUES) -> DataFrame:
    """(qid, k, p, recall, mrr, map, ndcg) of every query that has a judgement above 0.

    run: qid, did, rank from 1; qrels: qid, did, rel (int). A query without hits
    scores 0 throughout. Grades above 1 count as relevant, and as gains in
    nDCG. The hits of a query are reduced to relevant ones before anything is
    shuffled by query.
    """
    good = qrels.where("rel > 0")
    hits = run.join(good, ["qid", "did"]).select("qid", "rank", "rel")
    w = W.partitionBy("qid").orderBy("rank")
    hits = hits.withColumn("nth", F.row_number().over(w))
    total = good.groupBy("qid").agg(F.count("*").alias("n_rel"))
    top = max(ks)
    ideal = good.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rel"), "did"))).where(F.col("r") <= top)

    def gain(rank: str):
        return F.col("rel") / F.log2(F.col(rank) + 1.0)

    sums = [F.sum(F.when(F.col("r") <= k, gain("r"))).alias(f"i{k}") for k in ks]
    best = ideal.groupBy("qid").agg(*sums)
    aggs = []
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [
            F.count(F.when(inside, 1)).alias(f"h{k}"),
            F.max(F.when(inside, 1.0 / F.col("rank"))).alias(f"m{k}"),
            F.sum(F.when(inside, F.col("nth") / F.col("rank"))).alias(f"a{k}"),
            F.sum(F.when(inside, gain("rank"))).alias(f"d{k}"),
        ]
    wide = total.join(best, "qid").join(hits.groupBy("qid").agg(*aggs), "qid", "left")
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                (F.coalesce(f"h{k}", F.lit(0)) / F.lit(float(k))).alias("p"),
                (F.coalesce(f"h{k}", F.lit(0)) / F.col("n_rel")).alias("recall"),
                F.coalesce(f"m{k}", F.lit(0.0)).alias("mrr"),
                (F.coalesce(f"a{k}", F.lit(0.0)) / F.col("n_rel")).alias("map"),
                (F.coalesce(f"d{k}", F.lit(0.0)) / F.col(f"i{k}")).alias("ndcg"),
            )
            for k in ks
        ]
    )
    return wide.select("qid", F.explode(rows).alias("x")).select("qid", "x.*")


def averaged(scores: DataFrame, digits: int = 6) -> DataFrame:
    """Means over queries for each k."""
    names = ("p", "recall", "mrr", "map", "ndcg")
    return scores.groupBy("k").agg(*[F.round(F.avg(c), digits).alias(c) for c in names])
