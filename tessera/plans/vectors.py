"""Queries and SQL of vector operators, search, metrics, losses and indexes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import index as I
from tessera.operators import losses as L
from tessera.operators import metrics as M
from tessera.operators import search as S
from tessera.operators.encode import encode_texts, hashing_encoder, hashing_states
from tessera.operators.evaluation import benchmark, evaluate
from tessera.operators.scores import running_mean
from tessera.plans.sqltext import sql_top, sql_words
from tessera.session import shared_path
from tessera.sources import results as R
from tessera.sources.tables import table
from tessera.streaming import stream_into_index, windowed_counts


def _long(df: DataFrame, vector: Column, key: str = "vec_id") -> DataFrame:
    """(key, dim, x): a vector as rows, rounded for comparison."""
    return df.select(key, F.posexplode(vector).alias("dim", "x")).select(key, "dim", F.round("x", 6).alias("x"))


def _search(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    return S.top_k(S.every_hundredth(e), e, k)


def _rounded(run: DataFrame) -> DataFrame:
    return run.select("qid", "did", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _states() -> tuple[Column, Column]:
    """The vector as 8 states of 8 dimensions, and a mask of the first vec_id % 8 + 1 of them."""
    v = V.doubles("embedding")
    states = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(v, i * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i <= F.col("vec_id") % 8).cast("int"))
    return states, mask


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return _long(e, V.l2_normalize(F.transform(V.doubles("embedding"), lambda x: x * (F.col("vec_id") % 3))))


def mean_pool_masked(spark: SparkSession, d: str) -> DataFrame:
    return _long(table(spark, d, "embeddings"), V.mean_pool(*_states()))


def last_token_pool(spark: SparkSession, d: str) -> DataFrame:
    return _long(table(spark, d, "embeddings"), V.last_token_pool(*_states(), F.col("label") == 0))


def softmax(spark: SparkSession, d: str) -> DataFrame:
    return _long(table(spark, d, "embeddings"), V.softmax(V.doubles("embedding")))


def project_linear(spark: SparkSession, d: str) -> DataFrame:
    m = np.fromfunction(lambda i, j: (i * 7 + j * 3) % 5 - 2, (64, 4))
    return _long(V.project(table(spark, d, "embeddings"), m), F.col("projected"))


def gated_attention_pool(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of one label pooled by gated attention with fixed matrices."""
    i, j = np.meshgrid(np.arange(16), np.arange(64), indexing="ij")
    v, u, w = np.sin(i * 3 + j), np.cos(i + j * 2), np.sin(np.arange(16))
    out = V.pool_groups(table(spark, d, "embeddings"), v, u, w, group="label", vector="embedding")
    return _long(out, F.col("pooled"), "label")


def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_search(spark, d, 51))


def topk_self_excluded(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.drop_self(_search(spark, d, 51), 50))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the same label are relevant to each other."""
    e = table(spark, d, "embeddings")
    q = S.every_hundredth(e).select(F.col("vec_id").alias("qid"), "label")
    return q.join(e.select(F.col("vec_id").alias("did"), "label"), "label").where("qid <> did").select("qid", "did", F.lit(1).alias("rel"))


def run_join_judgements(spark: SparkSession, d: str) -> DataFrame:
    run = S.drop_self(_search(spark, d, 51), 50)
    return M.join_judgements(run, _judged(spark, d)).select("qid", "did", "rel")


def ir_metrics_at_k(spark: SparkSession, d: str) -> DataFrame:
    return M.averaged(M.per_query(S.drop_self(_search(spark, d, 51), 50), _judged(spark, d)))


def contrastive_losses(spark: SparkSession, d: str) -> DataFrame:
    out = L.batch_losses(L.batch_pairs(table(spark, d, "embeddings")))
    return out.select("batch_id", "n", "n_masked", *[F.round(c, 6).alias(c) for c in ("info_nce", "spherical", "masked_info_nce", "total")])


def mining_records_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Mining records written as JSON lines and read back."""
    return _roundtrip(spark, d, "jsonl")


def mining_records_columnar(spark: SparkSession, d: str) -> DataFrame:
    """The same through the columnar format."""
    return _roundtrip(spark, d, "parquet")


def _roundtrip(spark: SparkSession, d: str, fmt: str) -> DataFrame:
    """The top 100 of each query with its text."""
    texts = table(spark, d, "queries").groupBy(F.col("ord").alias("qid")).agg(F.max("text").alias("query"))
    path = shared_path(spark, f"records-{fmt}")
    R.save_records(S.mining_records(_search(spark, d, 100), texts), path, fmt)
    back = R.load_records(spark, path, fmt).select("query_id", "query", F.posexplode(F.arrays_zip("doc_ids", "scores")).alias("i", "h"))
    return back.select("query_id", "query", (F.col("i") + 1).cast("bigint").alias("rank"), F.col("h.doc_ids").alias("doc_id"), F.round("h.scores", 6).alias("score"))


def index_choice(spark: SparkSession, d: str) -> DataFrame:
    """The index that corpora of several sizes get."""
    sizes = (500, 99_999, 100_000, 250_000, 999_999, 1_000_000, 8_800_000)
    rows = [(n, (p := I.choose_index(n)).kind, p.cells, p.subspaces, p.bits) for n in sizes]
    return spark.createDataFrame(rows, "n bigint, kind string, cells int, subspaces int, bits int")


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, np.ndarray]:
    e = table(spark, d, "embeddings")
    centroids = I.train_cells(e, I.cell_count(e.count()))
    return e, I.assign_cells(e, centroids), centroids


def ivf_probe_all(spark: SparkSession, d: str) -> DataFrame:
    """Probing of all cells, which is exact."""
    e, cells, centroids = _cells(spark, d)
    return _rounded(I.probe(S.every_hundredth(e), cells, centroids, 10, nprobe=len(centroids)))


def ivf_index_saved(spark: SparkSession, d: str) -> DataFrame:
    """An index written, found again, loaded and probed in all cells."""
    e, cells, centroids = _cells(spark, d)
    path = shared_path(spark, "index")
    I.save_index(cells, centroids, path)
    if not I.index_exists(spark, path):
        raise RuntimeError("the index is not there")
    saved, c = I.load_index(spark, path)
    return _rounded(I.probe(S.every_hundredth(e), saved, c, 10, nprobe=len(c)))


def ivf_index_streamed(spark: SparkSession, d: str) -> DataFrame:
    """Extension: an index filled by a stream, then probed in all cells."""
    e, cells, centroids = _cells(spark, d)
    path = shared_path(spark, "stream-index")
    I.save_index(cells.where("false"), centroids, path)
    rows = spark.readStream.schema(e.schema).parquet(f"{d}/embeddings.parque[t]")
    stream_into_index(rows, path, shared_path(spark, "stream-state")).awaitTermination()
    saved, c = I.load_index(spark, path)
    return _rounded(I.probe(S.every_hundredth(e), saved, c, 10, nprobe=len(c)))


def ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10 against exact search at the share of cells that probing keeps to at any size."""
    e, cells, centroids = _cells(spark, d)
    found = I.probe(S.every_hundredth(e), cells, centroids, 10, nprobe=I.share_count(len(centroids)))
    return I.recall(found, S.top_k(S.every_hundredth(e), e, 10), 10)


def pq_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10 of search over product codes with exact scores for the best candidates."""
    e = table(spark, d, "embeddings")
    book = I.train_codebook(e, 16, 8)
    return I.recall(I.search_codes(S.every_hundredth(e), e, book, 10), S.top_k(S.every_hundredth(e), e, 10), 10)


def recalls_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whether the recall at 10 of each approximate search is 0.9 at least."""
    out = None
    for f in (ivf_recall, pq_recall, index_codes_recall):
        one = f(spark, d).select(F.lit(f.__name__).alias("search"), F.col("k").cast("int").alias("k"), (F.col("recall") >= 0.9).alias("enough"))
        out = one if out is None else out.unionByName(one)
    return out


def index_training_sample(spark: SparkSession, d: str) -> DataFrame:
    """The rows on which an index of a corpus is fitted: a hundred, the feature of the sampler."""
    return I.training_sample(table(spark, d, "embeddings"), 100).select("vec_id")


def hashed_query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all queries by the stand-in encoder."""
    return _long(encode_texts(table(spark, d, "queries"), hashing_encoder(64), key="ord", text="text"), F.col("embedding").cast("array<double>"), "ord")


def encoded_states_mean(spark: SparkSession, d: str) -> DataFrame:
    """Texts encoded to states, pooled by mean."""
    return _long(encode_texts(table(spark, d, "queries"), hashing_states(16), key="ord", text="text", pool="mean"), F.col("embedding").cast("array<double>"), "ord")


def encoded_states_last(spark: SparkSession, d: str) -> DataFrame:
    """Texts encoded to states that are padded on the right, pooled by their last token."""
    return _long(encode_texts(table(spark, d, "queries"), hashing_states(16), key="ord", text="text"), F.col("embedding").cast("array<double>"), "ord")


def last_token_pool_batched(spark: SparkSession, d: str) -> DataFrame:
    """Last-token pool where each batch of 8 texts is padded on one side, and the side is read off its masks."""
    states, _ = _states()
    place = F.sequence(F.lit(0), F.lit(7))
    left = F.col("batch") % 2 == 0
    mask = F.when(left, F.transform(place, lambda i: (i >= 7 - F.col("vec_id") % 8).cast("int"))).otherwise(F.transform(place, lambda i: (i <= F.col("vec_id") % 8).cast("int")))
    e = table(spark, d, "embeddings").withColumn("batch", F.floor(F.col("vec_id") / 8)).withColumn("mask", mask)
    e = e.withColumn("left", V.batch_left_padded(F.col("mask"), "batch"))
    return _long(e, V.last_token_pool(states, F.col("mask"), F.col("left")))


def embedding_model(spark: SparkSession, d: str) -> DataFrame:
    """States pooled by mean, projected and normalized."""
    m = np.fromfunction(lambda i, j: (i * 7 + j * 3) % 5 - 2, (8, 4))
    return _long(table(spark, d, "embeddings"), V.embed_states(*_states(), m))


def layer_gated_pool(spark: SparkSession, d: str) -> DataFrame:
    """Four layers of two states each, pooled by mean within a layer and by gated attention over the layers."""
    states, _ = _states()
    layers = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(states, i * 2 + 1, F.lit(2)))
    i, j = np.meshgrid(np.arange(3), np.arange(8), indexing="ij")
    v, u, w = np.sin(i * 3 + j), np.cos(i + j * 2), np.sin(np.arange(3) + 1)
    return _long(table(spark, d, "embeddings"), V.layer_pool(layers, F.array(F.lit(1), F.lit(1)), v, u, w))


def hard_negative_losses(spark: SparkSession, d: str) -> DataFrame:
    """Losses with two negatives of their own for every pair: the first document and the last query of its batch."""
    pairs = L.batch_pairs(table(spark, d, "embeddings"))
    w = W.partitionBy("batch_id")
    neg = F.array(F.min_by("d", "pos").over(w), F.max_by("q", "pos").over(w))
    return L.batch_hard_negative_losses(pairs.withColumn("neg", neg)).select("batch_id", "n", F.round("loss", 6).alias("loss"))


def evaluation_run(spark: SparkSession, d: str) -> DataFrame:
    """Queries against the whole corpus by the stand-in encoder: metrics at every cut-off."""
    return evaluate(*(table(spark, d, x) for x in ("queries", "corpus", "qrels")), hashing_encoder(64))


def benchmark_scores(spark: SparkSession, d: str) -> DataFrame:
    """Main scores of two evaluations run one after the other, with their running mean."""
    q, c, r = (table(spark, d, x) for x in ("queries", "corpus", "qrels"))
    tasks = [(f"hash{n}", "test", "Retrieval", lambda n=n: evaluate(q, c, r, hashing_encoder(n))) for n in (16, 64)]
    got = benchmark(spark, tasks)
    return running_mean(got, "task").select("task", "main_score", (F.col("seconds") > 0).alias("timed"), "running_mean")


def index_flat(spark: SparkSession, d: str) -> DataFrame:
    """An index by the plan for its size, saved and searched (flat below 100,000 vectors)."""
    e, path = table(spark, d, "embeddings"), shared_path(spark, "plan-index")
    I.build_index(e, path)
    return _rounded(I.search_index(S.every_hundredth(e), path, 10))


def index_cells(spark: SparkSession, d: str) -> DataFrame:
    """An index of cells by plan, probed in all of them."""
    e, path = table(spark, d, "embeddings"), shared_path(spark, "plan-index")
    plan = I.build_index(e, path, I.IndexPlan("ivf_flat", I.cell_count(e.count())))
    return _rounded(I.search_index(S.every_hundredth(e), path, 10, plan.cells))


def index_codes_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10 of an index of cells with product codes, three quarters of the cells probed, the best 80 candidates scored exactly."""
    e, path = table(spark, d, "embeddings"), shared_path(spark, "plan-index")
    plan = I.build_index(e, path, I.IndexPlan("ivf_pq", I.cell_count(e.count()), 16, 8))
    found = I.search_index(S.every_hundredth(e), path, 10, I.share_count(plan.cells), rerank=8)
    return I.recall(found, S.top_k(S.every_hundredth(e), e, 10), 10)


def events_by_hour(spark: SparkSession, d: str) -> DataFrame:
    """Extension: the batch form of the windowed stream."""
    out = windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        l2_normalize, mean_pool_masked, last_token_pool, softmax, project_linear, gated_attention_pool, topk_cosine, topk_self_excluded,
        run_join_judgements, ir_metrics_at_k, contrastive_losses, mining_records_roundtrip, mining_records_columnar, index_choice, ivf_probe_all,
        ivf_index_saved, ivf_index_streamed, ivf_recall, pq_recall, index_training_sample, hashed_query_vectors, events_by_hour,
        encoded_states_mean, encoded_states_last, last_token_pool_batched, embedding_model, layer_gated_pool, hard_negative_losses, evaluation_run,
        benchmark_scores, index_flat, index_cells, index_codes_recall, recalls_kept,
    )
}

_E0 = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS v FROM embeddings), i AS (SELECT unnest(range(64))::int AS dim), "
_TOP10 = sql_top(10) + "SELECT qid, did, round(score, 6) AS score, rank FROM t"
_REL = "r AS (SELECT a.vec_id AS qid, b.vec_id AS did FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) "
_RECORDS = (
    sql_top(100)
    + ", q AS (SELECT ord AS qid, max(text) AS query FROM queries GROUP BY 1) SELECT t.qid::varchar AS query_id, query, rank, did AS doc_id, round(score, 6) AS score FROM t LEFT JOIN q USING (qid)"
)
_LOSS = """WITH v AS (SELECT vec_id // 2 AS pos, vec_id % 2 AS side, list_transform(embedding, lambda x: x::double) AS v, label FROM embeddings),
p AS (SELECT a.pos, a.pos // 64 AS b, a.v AS q, d.v AS d, d.label AS id FROM v a JOIN v d ON a.pos = d.pos AND a.side = 0 AND d.side = 1),
x AS (SELECT i.b, i.pos AS i, j.pos AS j, list_inner_product(i.q, j.d) / 0.07::double AS l, list_inner_product(i.q, i.d) / 0.07::double AS pi, list_inner_product(j.q, j.d) / 0.07::double AS pj,
      i.id = j.id AS same, list_inner_product(i.q, j.q) AS qq, list_inner_product(i.d, j.d) AS dd FROM p i JOIN p j ON i.b = j.b),
y AS (SELECT *, i <> j AND (same OR l >= pi + 0.1::double) AS masked FROM x),
r AS (SELECT b, i, ln(sum(exp(l - pi))) AS a, ln(sum(CASE WHEN masked THEN 0 ELSE exp(l - pi) END)) AS m, sum(masked::int) AS nm FROM y GROUP BY 1, 2),
c AS (SELECT b, j, ln(sum(exp(l - pj))) AS k FROM y GROUP BY 1, 2),
s AS (SELECT b, coalesce(sum(CASE WHEN i <> j THEN qq * qq + dd * dd ELSE 0 END) / nullif(count(DISTINCT i) * (count(DISTINCT i) - 1), 0), 0) AS sph FROM y GROUP BY 1),
ra AS (SELECT b, count(*) AS n, avg(a) AS a, avg(m) AS m, sum(nm)::bigint AS n_masked FROM r GROUP BY 1), ca AS (SELECT b, avg(k) AS k FROM c GROUP BY 1)
SELECT b AS batch_id, n, n_masked, round((a + k) / 2, 6) AS info_nce, round(sph, 6) AS spherical, round(m, 6) AS masked_info_nce, round(sph + m, 6) AS total FROM ra JOIN ca USING (b) JOIN s USING (b)"""
#: Words of each query with the dimension and sign they have in the stand-in encoder of {n} dimensions.
_HASHED = (
    "WITH w AS (SELECT ord, unnest(" + sql_words("coalesce(text, '')") + ") AS w, generate_subscripts(" + sql_words("coalesce(text, '')") + ", 1) AS i FROM queries), "
    "h AS (SELECT ord, i, (('0x' || substr(md5(w), 1, 8))::bigint % {n})::int AS dim, CASE WHEN substr(md5(w), 9, 1) >= '8' THEN 1.0::double ELSE -1.0::double END AS s FROM w), "
    "q AS (SELECT DISTINCT ord FROM queries), g AS (SELECT ord, unnest(range({n}))::int AS dim FROM q), "
)
_UNIT = "l AS (SELECT ord, greatest(sqrt(sum(x * x)), 1e-12::double) AS l FROM c GROUP BY 1) SELECT g.ord, g.dim, round(coalesce(x / l, 0)::float::double, 6) AS x FROM g LEFT JOIN c ON g.ord = c.ord AND g.dim = c.dim LEFT JOIN l ON g.ord = l.ord"
_COUNTS = _HASHED + "c AS (SELECT ord, dim, sum(s) AS x FROM h GROUP BY 1, 2), " + _UNIT
_LAST = _HASHED + "c AS (SELECT ord, dim, s AS x FROM h QUALIFY i = max(i) OVER (PARTITION BY ord)), " + _UNIT


def _gate(items: str, v: str, u: str, d: int) -> str:
    """SQL for tanh(V h) * sigmoid(U h) of the list `items` of length d; v, u: entries in r and k."""
    a = f"list_sum(list_transform(range({d}), lambda k: {items}[k + 1] * {v}))"
    b = f"list_sum(list_transform(range({d}), lambda k: {items}[k + 1] * {u}))"
    return f"((1 - 2 / (exp(2 * {a}) + 1)) / (1 + exp(-{b})))"


_KS = ", ".join(f"({k})" for k in M.K_VALUES)

SQL = {
    "l2_normalize": _E0
    + "s AS (SELECT vec_id, list_transform(v, lambda x: x * (vec_id % 3)) AS v FROM e) SELECT vec_id, dim, round(v[dim + 1] / greatest(sqrt(list_inner_product(v, v)), 1e-12::double), 6) AS x FROM s, i",
    "mean_pool_masked": _E0
    + "s AS (SELECT unnest(range(8)) AS t) SELECT vec_id, dim, round(sum(v[t * 8 + dim + 1]) / (vec_id % 8 + 1), 6) AS x FROM e, i, s WHERE dim < 8 AND t <= vec_id % 8 GROUP BY vec_id, dim",
    "last_token_pool": _E0 + "o AS (SELECT 1) SELECT vec_id, dim, round(CASE WHEN label = 0 THEN v[57 + dim] ELSE v[(vec_id % 8) * 8 + dim + 1] END, 6) AS x FROM e, i WHERE dim < 8",
    "softmax": _E0
    + "s AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS v FROM e) SELECT vec_id, dim, round(v[dim + 1] / list_sum(v), 6) AS x FROM s, i",
    "project_linear": _E0
    + "o AS (SELECT 1) SELECT vec_id, dim, round(list_sum(list_transform(range(64), lambda k: v[k + 1] * ((k * 7 + dim * 3) % 5 - 2))), 6) AS x FROM e, i WHERE dim < 4",
    "topk_cosine": sql_top(51) + "SELECT qid, did, round(score, 6) AS score, rank FROM t",
    "topk_self_excluded": sql_top(50, self_excluded=True) + "SELECT qid, did, round(score, 6) AS score, rank FROM t",
    "run_join_judgements": sql_top(50, self_excluded=True) + f", {_REL} SELECT t.qid, t.did, CASE WHEN r.did IS NULL THEN 0 ELSE 1 END AS rel FROM t LEFT JOIN r ON t.qid = r.qid AND t.did = r.did",
    "ir_metrics_at_k": sql_top(50, self_excluded=True)
    + f""", {_REL}, n AS (SELECT qid, count(*) AS n FROM r GROUP BY 1), k AS (SELECT * FROM (VALUES {_KS}) v(k)),
        hit AS (SELECT t.qid, t.rank, row_number() OVER (PARTITION BY t.qid ORDER BY t.rank) AS nth FROM t JOIN r ON t.qid = r.qid AND t.did = r.did),
        g AS (SELECT unnest(range(1, 51)) AS i),
        q AS (SELECT n.qid, k.k, n.n, count(hit.rank) AS hits, coalesce(max(1.0::double / hit.rank), 0) AS mrr, coalesce(sum(hit.nth::double / hit.rank), 0) / n.n AS map,
                     coalesce(sum(1.0::double / log2(hit.rank + 1)), 0) AS dcg FROM n CROSS JOIN k LEFT JOIN hit ON hit.qid = n.qid AND hit.rank <= k.k GROUP BY 1, 2, 3),
        z AS (SELECT q.*, (SELECT sum(1.0::double / log2(i + 1)) FROM g WHERE i <= least(q.n, q.k)) AS idcg FROM q)
        SELECT k, round(avg(hits::double / k), 6) AS p, round(avg(hits::double / n), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(map), 6) AS map, round(avg(dcg / idcg), 6) AS ndcg FROM z GROUP BY k""",
    "contrastive_losses": _LOSS,
    "mining_records_roundtrip": _RECORDS,
    "mining_records_columnar": _RECORDS,
    "index_choice": """SELECT * FROM (VALUES (500::bigint, 'flat', 0, 0, 0), (99999, 'flat', 0, 0, 0), (100000, 'ivf_flat', 316, 0, 0), (250000, 'ivf_flat', 500, 0, 0),
        (999999, 'ivf_flat', 999, 0, 0), (1000000, 'ivf_pq', 8192, 64, 8), (8800000, 'ivf_pq', 8192, 64, 8)) v(n, kind, cells, subspaces, bits)""",
    "ivf_probe_all": _TOP10,
    "ivf_index_saved": _TOP10,
    "ivf_index_streamed": _TOP10,
    "recalls_kept": "SELECT * FROM (VALUES ('ivf_recall', 10, true), ('pq_recall', 10, true), ('index_codes_recall', 10, true)) v(search, k, enough)",
    "index_flat": _TOP10,
    "index_cells": _TOP10,
    "index_training_sample": "SELECT vec_id FROM embeddings ORDER BY md5('0/' || vec_id::varchar), vec_id LIMIT 100",
    "hashed_query_vectors": _COUNTS.format(n=64),
    "encoded_states_mean": _COUNTS.format(n=16),
    "encoded_states_last": _LAST.format(n=16),
    "last_token_pool_batched": _E0
    + """o AS (SELECT 1) SELECT vec_id, dim, round(CASE WHEN (vec_id // 8) % 2 = 0 OR vec_id % 8 = 7 THEN v[57 + dim] ELSE v[(vec_id % 8) * 8 + dim + 1] END, 6) AS x FROM e, i WHERE dim < 8""",
    "embedding_model": _E0
    + """s AS (SELECT vec_id, list_transform(range(8), lambda k: list_sum(list_transform(range((vec_id % 8 + 1)), lambda t: v[t * 8 + k + 1])) / (vec_id % 8 + 1)) AS m FROM e),
        p AS (SELECT vec_id, list_transform(range(4), lambda j: list_sum(list_transform(range(8), lambda k: m[k + 1] * ((k * 7 + j * 3) % 5 - 2)))) AS p FROM s)
        SELECT vec_id, dim, round(p[dim + 1] / greatest(sqrt(list_inner_product(p, p)), 1e-12::double), 6) AS x FROM p, i WHERE dim < 4""",
    "layer_gated_pool": _E0
    + f"""t AS (SELECT unnest(range(4)) AS t), r AS (SELECT unnest(range(3)) AS r),
        m AS (SELECT vec_id, t, list_transform(range(8), lambda k: (v[t * 16 + k + 1] + v[t * 16 + 8 + k + 1]) / 2) AS h FROM e, t),
        g AS (SELECT vec_id, t, any_value(h) AS h, sum({_gate("h", "sin(r * 3 + k)", "cos(r + k * 2)", 8)} * sin(r + 1)) * sqrt(8.0::double) AS s FROM m, r GROUP BY 1, 2),
        z AS (SELECT vec_id, t, h, exp(s - max(s) OVER (PARTITION BY vec_id)) AS x FROM g)
        SELECT vec_id, dim, round(sum(h[dim + 1] * x) / sum(x), 6) AS x FROM z, i WHERE dim < 8 GROUP BY 1, 2""",
    "gated_attention_pool": _E0
    + f"""r AS (SELECT unnest(range(16)) AS r),
        g AS (SELECT vec_id, any_value(label) AS label, any_value(v) AS v, sum({_gate("v", "sin(r * 3 + k)", "cos(r + k * 2)", 64)} * sin(r)) * 8.0::double AS s FROM e, r GROUP BY 1),
        z AS (SELECT label, v, exp(s - max(s) OVER (PARTITION BY label)) AS x FROM g)
        SELECT label::bigint AS label, dim, round(sum(v[dim + 1] * x) / sum(x), 6) AS x FROM z, i GROUP BY 1, 2""",
    "hard_negative_losses": """WITH v AS (SELECT vec_id // 2 AS pos, vec_id % 2 AS side, list_transform(embedding, lambda x: x::double) AS v FROM embeddings),
        p AS (SELECT a.pos, a.pos // 64 AS b, a.v AS q, d.v AS d FROM v a JOIN v d ON a.pos = d.pos AND a.side = 0 AND d.side = 1),
        n AS (SELECT b, arg_min(d, pos) AS n1, arg_max(q, pos) AS n2 FROM p GROUP BY 1),
        x AS (SELECT b, pos, list_inner_product(q, d) / 0.07::double AS o, list_inner_product(q, n1) / 0.07::double AS a, list_inner_product(q, n2) / 0.07::double AS c FROM p JOIN n USING (b)),
        y AS (SELECT i.b, i.pos, sum(exp(list_inner_product(i.q, j.d) / 0.07::double - list_inner_product(i.q, i.d) / 0.07::double)) AS s FROM p i JOIN p j ON i.b = j.b GROUP BY 1, 2)
        SELECT x.b AS batch_id, count(*) AS n, round(avg(ln(1 + s + exp(a - o) + exp(c - o))), 6) AS loss FROM x JOIN y ON x.b = y.b AND x.pos = y.pos GROUP BY 1""",
    "events_by_hour": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
