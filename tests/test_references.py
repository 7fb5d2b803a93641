import random
from datetime import datetime, timedelta

from tessera.operators.references import Parent, orphan_references, orphan_report

T0 = datetime(2024, 1, 1)
REFS = "`query-id` string, `corpus-id` string, ord bigint, judged_at timestamp_ntz, spans string, k string"
ROWS = "_id string, added_at timestamp_ntz, deleted_at timestamp_ntz, hot string"


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def run(spark, refs, corpus, queries):
    r = spark.createDataFrame([(q, c, o, day(t), "", "") for q, c, o, t in refs], REFS)
    ps = [Parent(n, spark.createDataFrame([(i, day(a), day(z), "") for i, a, z in rows], ROWS), f) for n, rows, f in (("corpus", corpus, "corpus-id"), ("queries", queries, "query-id"))]
    found = sorted(tuple(x) for x in orphan_references(r, ps).collect())
    report = {(x.ref_table, x.period): (x.refs, x.orphans) for x in orphan_report(r, ps).collect()}
    return found, report


def test_spellings_blanks_and_life_times(spark):
    corpus = [("10", 0, 5), ("10.0", 7, None), ("011", 0, None), (None, 0, None), ("12", None, None)]
    queries = [("1", 0, None)]
    refs = [
        ("1", " 10", 1, 0),  # live from added_at on
        ("1", "10", 2, 5),  # not at deleted_at
        ("１", "10", 3, 6),  # between two lives
        ("1.0", "10", 4, 7),
        (None, "", 5, 1),  # no references
        ("  ", "1x", 6, 1),  # a damaged id is an orphan
        ("2", "11\n", 7, None),  # no time: nothing is live
        ("1", "12", 8, 1),  # a parent without a start is never live
        ("1", "12", 8, 1),  # repeated rows count one by one
    ]
    found, report = run(spark, refs, corpus, queries)
    assert found == [(2, "corpus"), (3, "corpus"), (6, "corpus"), (7, "corpus"), (7, "queries"), (8, "corpus"), (8, "corpus")]
    assert report[("corpus", "2024-01")] == (7, 5)
    assert report[("corpus", None)] == (1, 1)
    assert report[("queries", None)] == (1, 1)


def test_hot_keys_on_both_sides_match_brute_force(spark):
    rng = random.Random(3)
    corpus = [(str(rng.choice([7, 7, rng.randrange(50)])), a := rng.randrange(100), rng.choice([None, a + rng.randrange(1, 9)])) for _ in range(400)]
    corpus = [(i, a, z) for i, a, z in corpus if not (i == "7" and z is None)]
    refs = [("1", str(rng.choice([7, rng.randrange(60)])), o, rng.randrange(-5, 110)) for o in range(1500)]
    found, _ = run(spark, refs, corpus, [("1", -99, None)])
    want = sorted((o, "corpus") for _, c, o, t in refs if not any(i == c and a <= t and (z is None or t < z) for i, a, z in corpus))
    assert found == want


def test_empty_tables(spark):
    assert run(spark, [], [], []) == ([], {})
    assert run(spark, [("1", "2", 1, 1)], [], [])[0] == [(1, "corpus"), (1, "queries")]
