from tessera.operators import pairs as P

CORPUS = "_id string, title string, text string, ord bigint, extra int"
QUERIES = "_id string, text string, ord bigint, title string"
QRELS = "`query-id` string, `corpus-id` string, score int, ord bigint, text string"


def build(spark, qrels, corpus, queries):
    out = P.build_pairs(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(corpus, CORPUS), spark.createDataFrame(qrels, QRELS))
    return [tuple(r) for r in out.orderBy("first_ord").collect()]


def test_last_judgement_wins_and_first_gives_the_order(spark):
    qrels = [("1", "10", 1, 1, ""), ("2", "11", 1, 2, ""), (" 1", "12.0", 1, 3, "")]
    corpus = [("10", "", "a", 1, 0), ("11", "T", "b", 2, 0), ("012", None, "c", 3, 0)]
    got = build(spark, qrels, corpus, [("1", "q1", 1, ""), ("2", "q2", 2, "")])
    assert got == [("1", "q1", "12", "none", "c", 1), ("2", "q2", "11", "T", "b", 2)]


def test_missing_last_document_drops_the_query(spark):
    assert build(spark, [("1", "10", 1, 1, ""), ("1", "99", 1, 2, "")], [("10", "", "a", 1, 0)], [("1", "q", 1, "")]) == []


def test_other_grades_nulls_and_repeats(spark):
    qrels = [("1", "10", 2, 1, ""), ("1", "10", None, 2, ""), (None, "10", 1, 3, ""), ("2", "10", 1, 4, ""), ("2", "10", 1, 5, ""), ("3", None, 1, 6, "")]
    corpus = [("10", "", "old", 1, 0), ("10", "", "new", 2, 0), (None, "", "x", 3, 0)]
    got = build(spark, qrels, corpus, [("1", "q1", 1, ""), ("2", "q2", 2, ""), ("3", "q3", 3, ""), (None, "q", 4, "")])
    assert got == [("2", "q2", "10", "none", "new", 4)]


def test_empty_tables(spark):
    assert build(spark, [], [], []) == []
