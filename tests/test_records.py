import numpy as np
import pytest

from tessera.plans import vectors as X


@pytest.mark.parametrize("query", ["mining_records_roundtrip", "mining_records_columnar"])
def test_records_have_their_own_text_and_100_hits(spark, tmp_path, monkeypatch, query):
    m = np.random.default_rng(6).normal(size=(2001, 8))
    spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(m)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(f"text {i}", i) for i in range(2001)], "text string, ord bigint").write.parquet(f"{tmp_path}/queries.parquet")
    monkeypatch.setattr(X, "shared_path", lambda spark, name: f"{tmp_path}/out/{name}")
    got = X.QUERIES[query](spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {str(i) for i in range(0, 2001, 100)}
    for q, rows in by.items():
        assert {r["query"] for r in rows} == {f"text {q}"}
        assert sorted(r["rank"] for r in rows) == list(range(1, 101)) and len({r.doc_id for r in rows}) == 100
