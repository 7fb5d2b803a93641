from tessera.llm import neardup as N


def test_a_short_row_does_not_hide_a_long_one_of_the_same_set(spark):
    cycle = "a b c " * 8
    rows = [(1, "a b c a b"), (2, cycle), (3, cycle + "d")]
    pairs, members = N.similar_sets(spark.createDataFrame(rows, "row_id bigint, text string").coalesce(1), width=3, threshold=0.5, least_words=20)
    by = {r.set_hash: r.row_id for r in members.collect()}
    assert sorted(by.values()) == [2, 3]
    assert [({by[p.a], by[p.b]}, p.similarity) for p in pairs.collect()] == [({2, 3}, 0.75)]
