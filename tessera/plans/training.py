"""Queries and SQL of batching, lengths, schedules and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import schedules as H
from tessera.operators import batching as B
from tessera.operators import losses as L
from tessera.operators import scores as A
from tessera.session import shared_path
from tessera.sources import results as R
from tessera.sources.tables import table

REPLICAS, BATCH = 8, 32


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    """The tokenized table with true total lengths."""
    return table(spark, d, "tokenized_dataset").withColumn("total_len", F.col("query_len") + F.col("pos_len"))


def _sorted(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return B.by_length(_lengths(spark, d).select("example_id", "total_len", *columns))


def _digest(ids: Column) -> Column:
    return F.md5(F.array_join(ids, ","))


def length_stats(spark: SparkSession, d: str) -> DataFrame:
    t = B.length_totals(table(spark, d, "tokenized_dataset"))
    return t.select("n_pairs", "n_tokens", F.round("mean_query_len", 6).alias("mean_query_len"), F.round("mean_pos_len", 6).alias("mean_pos_len"), "max_len")


def longest_30(spark: SparkSession, d: str) -> DataFrame:
    return B.longest(_lengths(spark, d)).select("example_id", "total_len")


def length_sorted_replicas(spark: SparkSession, d: str) -> DataFrame:
    return B.to_replicas(_sorted(spark, d), REPLICAS).select("example_id", "pos", "replica", "replica_pos", "padded")


def replicas_drop_last(spark: SparkSession, d: str) -> DataFrame:
    return B.to_replicas(_sorted(spark, d), 7, drop_last=True).select("example_id", "pos", "replica", "replica_pos")


def bucket_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Places permuted within buckets."""
    return B.shuffle_in_buckets(_sorted(spark, d), REPLICAS, 42).select("example_id", "pos")


def fixed_batches(spark: SparkSession, d: str) -> DataFrame:
    return B.in_batches(_sorted(spark, d), BATCH).groupBy("batch_id").agg(F.count("*").alias("n"), F.max("total_len").alias("longest"), F.sum("total_len").alias("tokens"))


def batch_padding_mask(spark: SparkSession, d: str) -> DataFrame:
    t = B.in_batches(_sorted(spark, d, "query_token_ids", "pos_token_ids"), BATCH)
    t = B.pad_by_token(t, "query_token_ids", "pos_token_ids", pad=25378)
    cols = [_digest(F.col(c)).alias(c) for c in ("query_token_ids", "pos_token_ids", "query_token_ids_mask", "pos_token_ids_mask")]
    return t.select("example_id", F.size("pos_token_ids").alias("width"), *cols)


def batch_padding_left(spark: SparkSession, d: str) -> DataFrame:
    t = B.pad_by_length(B.in_batches(_sorted(spark, d, "query_token_ids"), BATCH), "query_token_ids", left=True)
    return t.select("example_id", *[_digest(F.col(c)).alias(c) for c in ("query_token_ids", "query_token_ids_mask")])


def joint_batch(spark: SparkSession, d: str) -> DataFrame:
    t = B.joint_batch(B.in_batches(_sorted(spark, d, "query_token_ids", "pos_token_ids"), BATCH), "query_token_ids", "pos_token_ids")
    return t.select("batch_id", "pos", "side", _digest(F.col("ids")).alias("ids"), _digest(F.col("ids_mask")).alias("mask"))


def _negatives() -> Column:
    return F.slice(F.array("pos_token_ids", "query_token_ids"), 1, (F.col("example_id") % 3).cast("int"))


def pad_negatives(spark: SparkSession, d: str) -> DataFrame:
    t = _sorted(spark, d, "query_token_ids", "pos_token_ids").withColumn("neg", _negatives())
    t = B.pad_negatives(B.in_batches(t, BATCH), "neg")
    return t.select("example_id", F.size("neg").alias("n"), _digest(F.flatten("neg")).alias("neg"))


def negative_lengths(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tokenized_dataset").withColumn("neg", _negatives())
    mean = B.mean_negative_length(F.col("neg"), 2)
    return t.select("example_id", mean.alias("mean_negative"), B.total_length(F.col("query_len"), F.col("pos_len"), mean, 2).alias("total_len"))


def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    return H.lr_schedule(spark, 200, H.warmup_steps(200, ratio=0.03), 0.1).select("step", F.round("multiplier", 8).alias("multiplier"))


def lr_schedule_alone(spark: SparkSession, d: str) -> DataFrame:
    return H.lr_schedule(spark, 1000, H.warmup_steps_alone(1000, ratio=0.05)).select("step", F.round("multiplier", 8).alias("multiplier"))


def step_schedule_linear(spark: SparkSession, d: str) -> DataFrame:
    return H.linear_steps(spark, 8, 1000).unionByName(H.linear_steps(spark, 16, 40))


def step_schedule_log(spark: SparkSession, d: str) -> DataFrame:
    return H.log_steps(spark, 20, 200)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Task results: one per event type and parity, with a score, a kind and a time."""
    split = F.when(F.col("event_id") % 2 == 0, "test").otherwise("dev").alias("split")
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("task"), split).agg(F.round(F.avg("value") / 1000, 5).alias("main_score"), (F.count("*") / 4).alias("seconds"))
    return g.withColumn("task_type", F.lit("Retrieval"))


def results_by_task(spark: SparkSession, d: str) -> DataFrame:
    return R.collect_task_results(_scores(spark, d))


def results_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Results of all splits written as JSON objects keyed by task and read back."""
    path = shared_path(spark, "results")
    R.save_task_results(R.collect_task_results(_scores(spark, d)), path)
    return R.load_task_results(spark, path)


def mean_main_score(spark: SparkSession, d: str) -> DataFrame:
    return A.mean_score(_scores(spark, d)).select(F.round("mean", 6).alias("mean"))


def running_mean_score(spark: SparkSession, d: str) -> DataFrame:
    scores = _scores(spark, d).withColumn("task", F.concat_ws("/", "task", "split"))
    return A.running_mean(scores, "task").select("task", F.round("running_mean", 6).alias("running_mean"))


def loss_interval_avg(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select((F.col("event_id") + 1).alias("step"), F.col("value").alias("loss"))
    return L.interval_loss(log, 50).select("bucket", F.round("avg_loss", 6).alias("avg_loss"))


def training_log_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A log appended to twice and read back."""
    path = shared_path(spark, "log")
    R.append_log(spark, path, {"lr": 0.1}, {10: 2.5, 20: 2.25})
    R.append_log(spark, path, {"lr": 0.1}, {30: 2.0})
    return R.load_log(spark, path)


def token_throughput(spark: SparkSession, d: str) -> DataFrame:
    return A.throughput(_lengths(spark, d), "total_len", 10.0, 8).select("tokens", F.round("per_second", 4).alias("per_second"))


QUERIES = {
    f.__name__: f
    for f in (
        length_stats, longest_30, length_sorted_replicas, replicas_drop_last, bucket_shuffle, fixed_batches, batch_padding_mask, batch_padding_left,
        joint_batch, pad_negatives, negative_lengths, lr_schedule, lr_schedule_alone, step_schedule_linear, step_schedule_log, results_by_task,
        results_json_roundtrip, mean_main_score, running_mean_score, loss_interval_avg, training_log_roundtrip, token_throughput,
    )
}

_P = "p AS (SELECT *, query_len + pos_len AS len, row_number() OVER (ORDER BY query_len + pos_len DESC, example_id) - 1 AS pos FROM tokenized_dataset) "
_B = f"WITH {_P}, b AS (SELECT *, pos // {BATCH} AS batch_id FROM p), "


def _mask(ids: str, pad: int) -> str:
    return f"list_transform({ids}, lambda x: CASE WHEN x <> {pad} THEN 1 ELSE 0 END)"


def _md5(ids: str) -> str:
    return f"md5(array_to_string({ids}, ','))"


def _lr(total: int, warmup: int, floor: float) -> str:
    return f"""SELECT step, round(least({floor}::double + (1 - {floor}::double) * least(step, {warmup}) / {warmup}::double,
        {floor}::double + 0.5::double * (1 - {floor}::double) * (1 + cos(greatest(0, step - {warmup})::double / ({total} - {warmup}) * pi()))), 8) AS multiplier
        FROM (SELECT unnest(range({total})) AS step)"""


_SCORES = """WITH s AS (SELECT event_type AS task, CASE WHEN event_id % 2 = 0 THEN 'test' ELSE 'dev' END AS split, round(avg(value) / 1000, 5) AS main_score,
    'Retrieval' AS task_type, printf('%.2f', count(*) / 4.0::double) AS time FROM events GROUP BY 1, 2) """

SQL = {
    "length_stats": """SELECT count(*) AS n_pairs, sum(query_len + pos_len)::bigint AS n_tokens, round(avg(query_len), 6) AS mean_query_len, round(avg(pos_len), 6) AS mean_pos_len,
        max(query_len + pos_len) AS max_len FROM tokenized_dataset""",
    "longest_30": "SELECT example_id, query_len + pos_len AS total_len FROM tokenized_dataset ORDER BY query_len + pos_len DESC, example_id LIMIT 30",
    "length_sorted_replicas": f"""WITH {_P}, n AS (SELECT count(*) AS n FROM p), r AS (SELECT example_id, pos, (pos % {REPLICAS})::int AS replica, pos // {REPLICAS} AS replica_pos, false AS padded FROM p),
        own AS (SELECT replica, count(*) AS own FROM r GROUP BY 1)
        SELECT * FROM r UNION ALL SELECT example_id, pos, replica, replica_pos + own, true FROM r JOIN own USING (replica), n WHERE replica_pos < (n.n + {REPLICAS} - 1) // {REPLICAS} - own""",
    "replicas_drop_last": f"WITH {_P} SELECT example_id, pos, (pos % 7)::int AS replica, pos // 7 AS replica_pos FROM p WHERE pos // 7 < (SELECT count(*) FROM p) // 7",
    "bucket_shuffle": f"""WITH {_P}, b AS (SELECT example_id, pos, pos // {REPLICAS * 100} AS bucket FROM p)
        SELECT example_id, bucket * {REPLICAS * 100} + row_number() OVER (PARTITION BY bucket ORDER BY md5(pos::varchar || '/42'), pos) - 1 AS pos FROM b""",
    "fixed_batches": _B + "o AS (SELECT 1) SELECT batch_id, count(*) AS n, max(len) AS longest, sum(len)::bigint AS tokens FROM b GROUP BY 1",
    "batch_padding_mask": _B
    + f"""m AS (SELECT example_id, list_resize(query_token_ids, max(len(query_token_ids)) OVER w, 25378) AS q, list_resize(pos_token_ids, max(len(pos_token_ids)) OVER w, 25378) AS d FROM b WINDOW w AS (PARTITION BY batch_id))
        SELECT example_id, len(d)::int AS width, {_md5('q')} AS query_token_ids, {_md5('d')} AS pos_token_ids, {_md5(_mask('q', 25378))} AS query_token_ids_mask, {_md5(_mask('d', 25378))} AS pos_token_ids_mask FROM m""",
    "batch_padding_left": _B
    + f"""m AS (SELECT example_id, query_token_ids AS q, max(len(query_token_ids)) OVER (PARTITION BY batch_id) - len(query_token_ids) AS gap FROM b)
        SELECT example_id, {_md5("list_concat(list_resize([]::int[], gap, 0), q)")} AS query_token_ids, {_md5("list_concat(list_resize([]::int[], gap, 0), list_transform(q, lambda x: 1))")} AS query_token_ids_mask FROM m""",
    "joint_batch": _B
    + f"""l AS (SELECT batch_id, pos, 0 AS side, query_token_ids AS ids FROM b UNION ALL SELECT batch_id, pos, 1, pos_token_ids FROM b),
        m AS (SELECT batch_id, pos, side, list_resize(ids, max(len(ids)) OVER (PARTITION BY batch_id), 0) AS ids FROM l)
        SELECT batch_id, pos, side, {_md5('ids')} AS ids, {_md5(_mask('ids', 0))} AS mask FROM m""",
    "pad_negatives": _B
    + f"""g AS (SELECT example_id, batch_id, [pos_token_ids, query_token_ids][1:(example_id % 3)] AS neg FROM b),
        m AS (SELECT example_id, neg, max(len(neg)) OVER w AS n, max(coalesce(list_max(list_transform(neg, lambda a: len(a))), 0)) OVER w AS m FROM g WINDOW w AS (PARTITION BY batch_id))
        SELECT example_id, n::int AS n, {_md5("list_resize(coalesce(flatten(list_transform(neg, lambda a: list_resize(a, m, 0))), []::int[]), n * m, 0)")} AS neg FROM m""",
    "negative_lengths": """WITH g AS (SELECT *, coalesce(list_sum(list_transform([pos_token_ids, query_token_ids][1:(example_id % 3)], lambda a: len(a))), 0) / 2.0::double AS m FROM tokenized_dataset)
        SELECT example_id, m AS mean_negative, query_len + pos_len + m * 2 AS total_len FROM g""",
    "lr_schedule": _lr(200, 6, 0.1),
    "lr_schedule_alone": _lr(1000, 50, 0.0),
    "step_schedule_linear": "SELECT unnest(range(0, 1000, 125)) AS step UNION ALL SELECT unnest(range(0, 40, 2))",
    "step_schedule_log": "SELECT DISTINCT round_even(pow(200.0::double, i / 20.0::double), 0)::bigint AS step FROM (SELECT unnest(range(20)) AS i)",
    "results_by_task": _SCORES + "SELECT * FROM s",
    "results_json_roundtrip": _SCORES + "SELECT * FROM s",
    "mean_main_score": _SCORES + "SELECT round(avg(main_score), 6) AS mean FROM s",
    "running_mean_score": _SCORES + "SELECT task || '/' || split AS task, round(avg(main_score) OVER (ORDER BY task || '/' || split ROWS UNBOUNDED PRECEDING), 6) AS running_mean FROM s",
    "loss_interval_avg": "SELECT event_id // 50 AS bucket, round(avg(value), 6) AS avg_loss FROM events GROUP BY 1",
    "training_log_roundtrip": """SELECT * FROM (VALUES ('{"lr": 0.1}', 10::bigint, 2.5::double), ('{"lr": 0.1}', 20, 2.25), ('{"lr": 0.1}', 30, 2.0)) v(train_params, step, avg_loss)""",
    "token_throughput": "SELECT sum(query_len + pos_len)::bigint AS tokens, round(sum(query_len + pos_len)::double / 80, 4) AS per_second FROM tokenized_dataset",
}
