import numpy as np
import pytest

from tessera.functions import vectors as V
from tessera.operators import evaluation as E
from tessera.operators.encode import encode_texts, hashing_encoder, hashing_states, pool_states
from tessera.sources import results as R


def tables(spark):
    q = spark.createDataFrame([("1", "red fox", 1), ("02", "blue whale", 2), (None, "x", 3), ("3", None, 4)], "_id string, text string, ord bigint")
    c = spark.createDataFrame([("10", "t", "red fox runs", 1), ("11", "t", "blue whale swims", 2), (" 12 ", "t", "green", 3), ("10", "t", "red fox", 4), ("1", "t", "red fox", 5)], "_id string, title string, text string, ord bigint")
    r = spark.createDataFrame([("1", "10", 1), ("2.0", "11", 2), ("2", "11", 1), ("3", "12", 0), (None, "10", 1)], "`query-id` string, `corpus-id` string, score int")
    return q, c, r


def test_evaluation_end_to_end(spark):
    got = {r.k: r for r in E.evaluate(*tables(spark), hashing_encoder(32), ks=(1, 3)).collect()}
    assert got[1].p == 1.0 and got[1].mrr == 1.0 and got[3].recall == 1.0 and got[3].ndcg == 1.0


def test_benchmark_and_saved_results(spark, tmp_path):
    t = tables(spark)
    got = E.benchmark(spark, [("a", s, "Retrieval", lambda: E.evaluate(*t, hashing_encoder(32), ks=(1, 10))) for s in ("dev", "test")])
    assert [(r.main_score, r.seconds > 0) for r in got.collect()] == [(1.0, True)] * 2
    R.save_task_results(R.collect_task_results(got), f"{tmp_path}/r")
    assert {(r.task, r.split, r.main_score) for r in R.load_task_results(spark, f"{tmp_path}/r").collect()} == {("a", "dev", 1.0), ("a", "test", 1.0)}
    (tmp_path / "pretty.json").write_text('{\n  "x": {\n    "main_score": 0.5,\n    "task_type": "Retrieval",\n    "time": "1.25",\n    "split": "test"\n  }\n}')
    assert [tuple(r) for r in R.load_task_results(spark, f"{tmp_path}/pretty.json").collect()] == [("x", 0.5, "Retrieval", "1.25", "test")]


def test_pools_of_a_batch():
    states = np.arange(24.0).reshape(2, 3, 4)
    right, left, full = np.array([[1, 1, 0], [1, 1, 1]]), np.array([[0, 1, 1], [1, 1, 1]]), np.array([[1, 0, 0], [0, 0, 1]])
    assert (pool_states(states, right, "last") == states[[0, 1], [1, 2]]).all()
    assert (pool_states(states, left, "last") == states[:, 2]).all()
    assert (pool_states(states, full, "last") == states[[0, 1], [0, 0]]).all()
    assert (pool_states(states, right, "mean")[0] == states[0, :2].mean(axis=0)).all()
    with pytest.raises(ValueError):
        pool_states(states, right, "max")


def test_states_pooled_by_mean_are_the_hashed_counts(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "c")], "id int, text string")
    one = {r.id: r.embedding for r in encode_texts(df, hashing_encoder(8), key="id", text="text").collect()}
    two = {r.id: r.embedding for r in encode_texts(df, hashing_states(8), key="id", text="text", pool="mean").collect()}
    assert all(np.allclose(one[i], two[i]) for i in one)


def test_gated_pool_of_a_row_equals_the_matrix_form(spark):
    rng = np.random.default_rng(0)
    m, v, u, w = rng.normal(size=(5, 4)), rng.normal(size=(3, 4)), rng.normal(size=(3, 4)), rng.normal(size=3)
    df = spark.createDataFrame([([[float(x) for x in r] for r in m],)], "h array<array<double>>")
    from pyspark.sql import functions as F

    assert np.allclose(df.select(V.gated_pool(F.col("h"), v, u, w)).first()[0], V.gated_attention_pool(m, v, u, w))


def test_no_local_folder_on_a_cluster():
    from tessera.session import ensure_checkpoint_dir

    class Conf:
        def get(self, _):
            return None

    class Sc:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda s: type("S", (), {"getCheckpointDir": lambda s: type("D", (), {"isDefined": lambda s: False})()})()})()

        def getConf(self):
            return Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(type("Spark", (), {"sparkContext": Sc()})())
