import pytest
from pyspark.sql import functions as F

from tessera.functions import schedules as H
from tessera.operators import batching as B


def frame(spark, n):
    return spark.range(n).select(F.col("id").alias("example_id"), F.lit(7).alias("total_len"), F.lit("x").alias("replica_x"))


def test_positions_with_ties_are_dense_and_ordered(spark):
    got = [tuple(r) for r in B.by_length(frame(spark, 1003)).select("pos", "example_id").orderBy("pos").collect()]
    assert got == [(i, i) for i in range(1003)]


def test_positions_of_nothing(spark):
    assert B.by_length(frame(spark, 0)).collect() == []


@pytest.mark.parametrize("n,replicas", [(103, 4), (8, 8), (5, 8), (100, 3)])
def test_replicas_are_padded_with_their_own_first_rows(spark, n, replicas):
    rows = B.to_replicas(B.by_length(frame(spark, n)), replicas).collect()
    each = -(-n // replicas)
    for r in range(min(replicas, n)):
        mine = sorted((x.replica_pos, x.pos) for x in rows if x.replica == r)
        own = list(range(r, n, replicas))
        assert [p for _, p in mine] == (own + own[: each - len(own)])
    dropped = B.to_replicas(B.by_length(frame(spark, n)), replicas, drop_last=True).collect()
    assert len(dropped) == n // replicas * replicas


def test_bucket_shuffle_permutes_inside_buckets_only(spark):
    base = B.by_length(frame(spark, 450))
    got = {r.example_id: r.pos for r in B.shuffle_in_buckets(base, 2, 1).collect()}
    assert sorted(got.values()) == list(range(450))
    assert all(i // 200 == p // 200 for i, p in got.items()) and any(i != p for i, p in got.items())
    assert got == {r.example_id: r.pos for r in B.shuffle_in_buckets(base, 2, 1).collect()}
    assert got != {r.example_id: r.pos for r in B.shuffle_in_buckets(base, 2, 2).collect()}


def test_mask_rules_differ_on_a_pad_token_inside(spark):
    df = spark.createDataFrame([(0, [5, 0, 7]), (0, [1]), (1, None), (1, [])], "batch_id int, ids array<int>")
    a = {tuple(r) if False else (r.batch_id, tuple(r.ids), tuple(r.ids_mask)) for r in B.pad_by_token(df, "ids").collect()}
    assert a == {(0, (5, 0, 7), (1, 0, 1)), (0, (1, 0, 0), (1, 0, 0)), (1, (), ())}
    b = {(tuple(r.ids), tuple(r.ids_mask)) for r in B.pad_by_length(df, "ids", left=True).collect()}
    assert b == {((5, 0, 7), (1, 1, 1)), ((0, 0, 1), (0, 0, 1)), ((), ())}


def test_steps(spark):
    assert [r.step for r in H.linear_steps(spark, 3, 10).orderBy("step").collect()] == [0, 3, 6, 9]
    assert [r.step for r in H.linear_steps(spark, 20, 10).orderBy("step").collect()] == list(range(10))
    log = [r.step for r in H.log_steps(spark, 10, 1000).orderBy("step").collect()]
    assert log == sorted({round(1000 ** (i / 10)) for i in range(10)})


def test_warmup():
    assert H.warmup_steps(200, ratio=0.03) == 6 and H.warmup_steps(10_000, ratio=0.5) == 20 and H.warmup_steps(10) == 5
    assert H.warmup_steps(10, ratio=None, steps=7) == 7 and H.warmup_steps(10, ratio=None) == 5
    assert H.warmup_steps_alone(10) == 3 and H.warmup_steps_alone(1000, ratio=0.05) == 50
