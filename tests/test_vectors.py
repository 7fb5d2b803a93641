import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import index as I
from tessera.operators import losses as L
from tessera.operators import metrics as M
from tessera.operators import search as S
from tessera.operators.encode import encode_texts, hashing_encoder
from tessera.sources import results as R

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, k int"


def vectors(spark, m, ids=None):
    ids = range(len(m)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v], 0, "s", 1) for i, v in zip(ids, m)], SCHEMA)


def brute(m, k):
    u = V.unit_rows(np.asarray(m, np.float32).astype(float))
    s = u @ u.T
    return {(i, int(j), r + 1) for i in range(len(m)) for r, j in enumerate(np.lexsort((np.arange(len(m)), -s[i]))[:k])}


def test_topk_equals_brute_force_in_blocks(spark):
    m = np.random.default_rng(0).normal(size=(90, 8))
    df = vectors(spark, m).repartition(5)
    for bytes_ in (1 << 20, 8 * 8 * 20):
        got = {(r.qid, r.did, r["rank"]) for r in S.top_k(df, df, 7, block_bytes=bytes_).collect()}
        assert got == brute(m, 7)


def test_topk_ties_nulls_zero_vectors_and_small_corpora(spark):
    df = vectors(spark, [[1, 0], [1, 0], [0, 0], [2, 0]], [5, 3, 4, 9]).unionByName(spark.createDataFrame([(None, [1.0, 0.0], 0, "", 1), (8, None, 0, "", 1)], SCHEMA))
    got = [(r.qid, r.did) for r in S.top_k(df.where("vec_id = 5"), df, 10).orderBy("rank").collect()]
    assert got == [(5, 3), (5, 5), (5, 9), (5, 4)]
    assert S.drop_self(S.top_k(df.where("vec_id = 5"), df, 3), 2).orderBy("rank").select("did", "rank").collect() == [(3, 1), (9, 2)]
    none = df.where("false")
    assert S.top_k(none, df, 3).collect() == [] and S.top_k(df, none, 3).collect() == []


def test_probe_of_all_cells_is_exact_and_recall_grows(spark):
    m = np.random.default_rng(1).normal(size=(200, 8))
    df = vectors(spark, m)
    c = I.train_cells(df, 14)
    cells = I.assign_cells(df, c)
    assert cells.count() == 200
    exact = S.top_k(df, df, 5)
    at = [I.recall(I.probe(df, cells, c, 5, nprobe=n), exact, 5).first().recall for n in (1, 7, 14)]
    assert at[0] < at[1] <= at[2] == 1.0 and at[1] > 0.8


def test_codes_find_most_neighbours(spark):
    m = np.random.default_rng(2).normal(size=(300, 16))
    df = vectors(spark, m)
    found = I.search_codes(df, df, I.train_codebook(df, 4, 6), 5)
    assert I.recall(found, S.top_k(df, df, 5), 5).first().recall >= 0.9
    with pytest.raises(ValueError):
        I.train_codebook(df, 5)


def test_index_saved_and_appended(spark, tmp_path):
    m = np.random.default_rng(3).normal(size=(60, 8))
    df = vectors(spark, m)
    c = I.train_cells(df, 5)
    path = str(tmp_path / "index")
    assert not I.index_exists(spark, path)
    I.save_index(I.assign_cells(df.where("vec_id < 30"), c), c, path)
    I.append_index(df.where("vec_id >= 30"), path)
    cells, c2 = I.load_index(spark, path)
    assert I.index_exists(spark, path) and np.allclose(c, c2)
    assert {(r.qid, r.did, r["rank"]) for r in I.probe(df, cells, c2, 4).collect()} == brute(m, 4)


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "qid int, did int, rank int")
    rel = spark.createDataFrame([(1, 11, 1), (1, 12, 1), (1, 99, 1), (3, 1, 1), (2, 10, 0)], "qid int, did int, rel int")
    got = {(r.qid, r.k): r for r in M.per_query(run, rel, (1, 3)).collect()}
    assert set(got) == {(1, 1), (1, 3), (3, 1), (3, 3)}
    r = got[1, 3]
    assert (r.p, r.recall, r.mrr) == (2 / 3, 2 / 3, 0.5)
    assert r.map == pytest.approx((1 / 2 + 2 / 3) / 3)
    ideal = 1 + 1 / np.log2(3) + 0.5
    assert r.ndcg == pytest.approx((1 / np.log2(3) + 0.5) / ideal)
    assert got[3, 3].ndcg == 0 and got[1, 1].p == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10_000))
def test_info_nce_is_not_negative_and_does_not_depend_on_order(n, seed):
    rng = np.random.default_rng(seed)
    q, d = V.unit_rows(rng.normal(size=(n, 4))), V.unit_rows(rng.normal(size=(n, 4)))
    p = rng.permutation(n)
    assert L.info_nce(q, d) >= -1e-12
    assert L.info_nce(q, d) == pytest.approx(L.info_nce(q[p], d[p]))
    ids = rng.integers(0, 3, n)
    a, b = L.masked_info_nce(q, d, ids), L.masked_info_nce(q[p], d[p], ids[p])
    assert a[0] >= -1e-12 and a[0] == pytest.approx(b[0]) and a[1] == b[1]


def test_margin_is_masked_at_equality():
    q = np.array([[1.0, 0.0], [0.0, 1.0]])
    # logits [[1, 1.5], ...] with temperature 1 and margin .5: exactly at the edge
    d = np.array([[1.0, 0.25], [1.5, 1.0]])
    assert L.masked_info_nce(q, d, np.array([0, 1]), 1.0, 0.5)[1] == 1
    assert L.masked_info_nce(q, d, np.array([0, 1]), 1.0, 0.5001)[1] == 0
    assert L.masked_info_nce(q, d, np.array([4, 4]), 1.0, 9.0)[1] == 2
    assert L.spherical(q[:1]) == 0.0


def test_hard_negatives_raise_the_loss():
    rng = np.random.default_rng(0)
    q, d = V.unit_rows(rng.normal(size=(4, 6))), V.unit_rows(rng.normal(size=(4, 6)))
    far, near = np.repeat(-q[:, None], 2, 1), np.repeat(q[:, None], 2, 1)
    assert L.hard_negative_loss(q, d, near) > L.hard_negative_loss(q, d, far)


def test_batch_losses_leave_out_null_vectors(spark):
    rows = [(0, i, i, [1.0, float(i)], [float(i), 1.0]) for i in range(3)] + [(0, 9, 9, None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "batch_id bigint, pos bigint, doc_id bigint, q array<double>, d array<double>")
    assert [r.n for r in L.batch_losses(df).collect()] == [3]
    assert L.batch_losses(df.where("false")).collect() == []


def test_pooling_in_parts_equals_the_whole(spark):
    rng = np.random.default_rng(5)
    m, v, u, w = rng.normal(size=(40, 6)), rng.normal(size=(3, 6)), rng.normal(size=(3, 6)), rng.normal(size=3)
    df = spark.createDataFrame([(i % 3, [float(x) for x in r]) for i, r in enumerate(m)], "g bigint, embedding array<double>").repartition(4)
    got = {r.g: r.pooled for r in V.pool_groups(df, v, u, w, group="g", vector="embedding").collect()}
    for g in range(3):
        assert np.allclose(got[g], V.gated_attention_pool(m[g::3], v, u, w))


def test_zero_vector_stays_zero_and_dot_of_unequal_lengths_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0])], "a array<double>, b array<double>")
    r = df.select(V.l2_normalize(F.col("a")), V.dot(F.col("a"), F.col("b"))).first()
    assert r[0] == [0.0, 0.0] and r[1] is None


def test_encoder_is_deterministic_and_takes_nulls(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "id int, text string")
    got = {r.id: r.embedding for r in encode_texts(df, hashing_encoder(8), key="id", text="text", projection=np.eye(8)[:, :4]).collect()}
    assert got[1] == got[3] and len(got[1]) == 4 and got[2] == [0.0] * 4


def test_record_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "q", [3, 4], [0.5, 0.25])], "query_id bigint, query string, doc_ids array<bigint>, scores array<double>")
    for fmt in R.FORMATS:
        R.save_records(df, str(tmp_path / fmt), fmt)
        assert [tuple(r) for r in R.load_records(spark, str(tmp_path / fmt), fmt).collect()] == [("1", "q", [3, 4], [0.5, 0.25])]
    with pytest.raises(ValueError, match="Unknown format"):
        R.save_records(df, str(tmp_path / "x"), "xml")
    for fmt in ("hdf5", "pickle", "npz"):
        with pytest.raises(ValueError, match=f"Format {fmt} is not supported"):
            R.save_records(df, str(tmp_path / "x"), fmt)
        with pytest.raises(ValueError, match=f"Format {fmt} is not supported"):
            R.load_records(spark, str(tmp_path / "x"), fmt)
