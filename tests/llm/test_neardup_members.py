from tessera.llm import queries as Q


def test_members_go_by_the_sets_of_p2_found(spark, tmp_path):
    # equal sets of three words, other sets of five
    texts = ["a b c a b d " * 4, "a b c a b c a b d a b d " * 2]
    spark.createDataFrame([(str(i), "", t, i) for i, t in enumerate(texts)], "_id string, title string, text string, ord bigint").write.parquet(f"{tmp_path}/corpus.parquet")
    spark.createDataFrame([], "positive_id string, positive_text string, ord bigint").write.parquet(f"{tmp_path}/data_doc.parquet")
    assert {tuple(r) for r in Q.QUERIES["p2_members"](spark, str(tmp_path)).collect()} == {(0, 0, 2, 0), (1, 0, 2, 0)}
    assert {r.class_id for r in Q.p2_classes(spark, str(tmp_path)).collect()} == {0, 1}
