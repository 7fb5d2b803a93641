import numpy as np
import pytest

from tessera.operators import index as I
from tessera.operators import search as S
from tessera.plans import vectors as X


@pytest.fixture
def many_cells(spark, tmp_path, monkeypatch):
    """A table of 4,000 vectors for which 1,000 cells are made."""
    m = np.random.default_rng(4).normal(size=(4000, 64))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(m)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(I, "cell_count", lambda n: 1000)
    monkeypatch.setattr(X, "shared_path", lambda spark, name: f"{tmp_path}/out/{name}")
    return str(tmp_path)


@pytest.mark.parametrize("query", ["ivf_probe_all", "ivf_index_saved", "ivf_index_streamed"])
def test_queries_are_exact_with_more_cells_than_128(spark, many_cells, query):
    e = spark.read.parquet(f"{many_cells}/embeddings.parquet")
    exact = {(r.qid, r.did, r["rank"]) for r in S.top_k(S.every_hundredth(e), e, 10).collect()}
    assert len(exact) == 400
    assert {(r.qid, r.did, r["rank"]) for r in X.QUERIES[query](spark, many_cells).collect()} == exact


def test_probing_keeps_recall_with_more_cells_than_128(spark, many_cells):
    e, cells, centroids = X._cells(spark, many_cells)
    assert len(centroids) == 1000
    queries = S.every_hundredth(e)
    at = I.recall(I.probe(queries, cells, centroids, 10), S.top_k(queries, e, 10), 10).first().recall
    assert at >= 0.9 and at == X.ivf_recall(spark, many_cells).first().recall


def test_probe_count_is_a_share_of_the_cells():
    assert [I.probe_count(n) for n in (0, 1, 44, 128, 130, 171, 316, 1000, 4096)] == [0, 1, 44, 128, 128, 129, 237, 750, 3072]


def clustered(spark, n=3000, dim=16, seed=5):
    """Vectors around 60 centres."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(60, dim))
    m = centre[rng.integers(0, 60, n)] + 0.3 * rng.normal(size=(n, dim))
    return spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in enumerate(m)], "vec_id bigint, embedding array<float>, cell string")


def hits(df):
    return {(r.qid, r.did, r["rank"]) for r in df.collect()}


def test_many_queries_go_to_groups_of_the_corpus(spark):
    df = clustered(spark, 500).unionByName(spark.createDataFrame([(None, [1.0] * 16, ""), (9999, None, "")], "vec_id bigint, embedding array<float>, cell string"))
    want = hits(S.top_k(df, df, 5))
    assert hits(S.top_k(df, df, 5, block_bytes=0, group_bytes=16 * 8 * 90)) == want
    assert S.top_k(df, df.where("false"), 5, block_bytes=0).collect() == []


def test_scores_are_bounded_whatever_the_queries(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(S, "SCORE_CELLS", 64)
    monkeypatch.setattr(S, "QUERY_CHUNK", 8)
    seen = []
    best = S.best_of_slab
    monkeypatch.setattr(S, "best_of_slab", lambda q, i, s, k: seen.append(s.size) or best(q, i, s, k))
    q, m = rng.normal(size=(21, 4)), rng.normal(size=(50, 4))
    tops = S.QueryTops(np.arange(21), q, 3)
    tops.add(np.arange(50), m)
    got = {(a, b) for x in tops.batches() for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}
    assert max(seen) <= 64 and got == {(i, int(j)) for i in range(21) for j in np.argsort(-(q[i] @ m.T))[:3]}


@pytest.mark.parametrize("codes", [False, True])
def test_many_queries_probe_cells_as_few_do(spark, codes):
    df = clustered(spark, 800)
    c = I.train_cells(df, 12)
    book = I.train_codebook(df, 4, 4) if codes else None
    rows = I.assign_cells(df, c, book)
    few = hits(I.probe(df, rows, c, 4, 3, book))
    assert hits(I.probe(df, rows, c, 4, 3, book, query_bytes=0, group_bytes=16 * 8 * 20)) == few


def files_read(df):
    """Files of the scan that is left once partitions are pruned."""
    df.collect()
    scans = df._jdf.queryExecution().executedPlan().collectLeaves()
    return scans.apply(0).metrics().apply("numFiles").value()


def test_a_probe_reads_the_folders_of_its_cells(spark, tmp_path):
    df = clustered(spark)
    c = I.train_cells(df, 160)
    I.save_index(I.assign_cells(df, c), c, f"{tmp_path}/index")
    rows, c = I.load_index(spark, f"{tmp_path}/index")
    every = len(rows.inputFiles())
    few = I._only(rows, np.array([3, 5]), len(c))
    assert few.count() == rows.where("cell in (3, 5)").count() > 0
    # folders of other cells are left out, and cells are looked for in the row groups of the rest
    read = [files_read(I._only(rows, np.arange(n), len(c))) for n in (1, 40, 160)]
    assert read[0] < read[1] < read[2] == every
    assert "PushedFilters: [In(cell, [3,5])" in few._jdf.queryExecution().executedPlan().toString().replace("IsNotNull(cell), ", "")


@pytest.mark.parametrize("plan", [I.IndexPlan("flat", 0), I.IndexPlan("ivf_flat", 54), I.IndexPlan("ivf_pq", 54, 8, 6)])
def test_an_index_by_plan(spark, tmp_path, plan):
    df = clustered(spark)
    path = f"{tmp_path}/{plan.kind}"
    assert I.build_index(df, path, plan) == plan
    queries = df.where("vec_id % 100 = 0")
    exact = S.top_k(queries, df, 10)
    found = I.search_index(queries, path, 10, nprobe=5)  # a tenth of the cells
    assert I.recall(found, exact, 10).first().recall >= (1.0 if plan.kind == "flat" else 0.9)
    if plan.kind != "flat":
        assert I.recall(I.search_index(queries, path, 10, nprobe=54, rerank=30), exact, 10).first().recall >= 0.999
    if plan.kind == "ivf_pq":
        more = spark.createDataFrame([(90_000, [float(x) for x in np.eye(16)[3]], "")], df.schema)
        for _ in range(2):  # a batch that is written again replaces itself
            I.append_index(more, path, 7)
        assert [r.did for r in I.search_index(more, path, 1, nprobe=54, rerank=400).collect()] == [90_000]
        assert spark.read.parquet(f"{path}/cells").count() == 3001


def test_what_no_index_can_be(spark, tmp_path):
    df = clustered(spark, 50)
    with pytest.raises(ValueError, match="Unknown index"):
        I.build_index(df, f"{tmp_path}/x", I.IndexPlan("tree", 1))
    with pytest.raises(ValueError, match="no index"):
        I.search_index(df, f"{tmp_path}/none", 3)
    with pytest.raises(ValueError, match="do not split"):
        I.build_index(df, f"{tmp_path}/y", I.IndexPlan("ivf_pq", 4, 5, 4))
    assert I.build_index(df, f"{tmp_path}/auto").kind == "flat"
    assert I.search_index(df.where("false"), f"{tmp_path}/auto", 3).collect() == []
