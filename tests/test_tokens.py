from hashlib import md5

from tessera.plans import text as X


def word_id(w):
    return int(md5(w.encode()).hexdigest()[:8], 16) % 30_000


def test_training_texts_keep_their_tail_up_to_the_limits(spark, tmp_path):
    sizes = {"1": (5, 10), "2": (20, 200), "3": (1100, 5000)}  # words of the query and of the passage
    texts = {q: tuple(" ".join(f"{side}{i}" for i in range(n)) for side, n in zip("qp", ns)) for q, ns in sizes.items()}
    spark.createDataFrame([(q, a, int(q)) for q, (a, _) in texts.items()], "_id string, text string, ord bigint").write.parquet(f"{tmp_path}/queries.parquet")
    spark.createDataFrame([(q, "T", b, int(q)) for q, (_, b) in texts.items()], "_id string, title string, text string, ord bigint").write.parquet(f"{tmp_path}/corpus.parquet")
    spark.createDataFrame([(q, q, 1, int(q)) for q in texts], "`query-id` string, `corpus-id` string, score int, ord bigint").write.parquet(f"{tmp_path}/qrels.parquet")
    got = {r.query_id: r for r in X.tokenized_examples(spark, str(tmp_path)).collect()}
    assert set(got) == set(texts)
    for q, (a, b) in texts.items():
        query, passage = (X.T.QUERY_PREFIX + a).split()[:1024], f"title: T | text: {b}".split()[:4096]
        assert (got[q].query_len, got[q].pos_len, got[q].total_len) == (len(query), len(passage), len(query) + len(passage))
        assert got[q].ids == md5(",".join(str(word_id(w)) for w in passage).encode()).hexdigest()
    assert got["3"].query_len == 1024 and got["3"].pos_len == 4096
