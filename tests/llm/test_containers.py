import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.containers import SumIndex, assign, fill_containers, filling_totals

SCHEMA = "example_id bigint, query_len int, pos_len int, item string, len string"


def check(lengths, cap):
    lengths = np.array(lengths, np.int64)
    seq, start = assign(lengths, cap)
    by = {}
    for s, b, n in zip(seq, start, lengths):
        by.setdefault(int(s), []).append((int(b), int(n)))
    for items in by.values():
        at = 0
        for b, n in sorted(x for x in items if x[1]):
            assert b == at
            at += n
        assert at <= cap
    return len({int(s) for s, n in zip(seq, lengths) if n})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=120))
def test_any_lengths_are_placed_without_overlap(lengths):
    n = check(lengths, 64)
    total = sum(lengths)
    assert -(-total // 64) <= n <= max(1, 2 * total // 64 + 1)


def best_fit_decreasing(lengths, cap):
    gaps = []
    for x in sorted((x for x in lengths if x), reverse=True):
        at = min((g, i) for i, g in enumerate(gaps) if g >= x)[1] if any(g >= x for g in gaps) else None
        if at is None:
            gaps.append(cap - x)
        else:
            gaps[at] -= x
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.lists(st.integers(1, 100), max_size=150), st.lists(st.sampled_from([7, 11, 23, 34, 51, 67, 90]), max_size=200), st.lists(st.integers(20, 50), max_size=150)))
def test_never_more_sequences_than_best_fit_decreasing(lengths):
    assert check(lengths, 100) <= best_fit_decreasing(lengths, 100)


def test_no_worse_than_best_fit_decreasing_on_large_mixes():
    rng = np.random.default_rng(3)
    for lengths, cap in ((rng.integers(1, 1001, 2000), 1000), (rng.choice([111, 333, 457, 901], 2000), 1000), (rng.integers(1, 32_769, 3000), 32_768), (rng.integers(330, 400, 2000), 1000)):
        assert check(lengths, cap) <= best_fit_decreasing(lengths.tolist(), cap)


def test_index_from_sums_to_combinations():
    counts = np.bincount([3, 5, 5, 11, 20], minlength=41)
    index = SumIndex(counts, 40)
    assert [index.exact(g) for g in (20, 8, 10, 13, 16, 19, 36)] == [(20,), (5, 3), (5, 5), (5, 5, 3), (11, 5), (11, 5, 3), (20, 11, 5)]
    assert index.exact(15) is None and index.exact(6) is None and index.exact(33) is None
    index.take([5])
    assert index.exact(10) is None and index.exact(8) == (5, 3)


def test_exact_complements_leave_no_room():
    assert check([60, 40, 50, 30, 20, 70, 10, 20, 100], 100) == 4
    assert check([51] * 10 + [49] * 10, 100) == 10
    assert check([34, 33, 33] * 50, 100) == 50


def test_many_items_come_close_to_the_bound():
    lengths = np.random.default_rng(0).integers(1, 600, 20_000)
    assert check(lengths, 2048) <= -(-lengths.sum() // 2048) + 1


def run(spark, rows, cap=10, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return [tuple(r) for r in fill_containers(df, F.col("query_len") + F.col("pos_len"), cap, **kw).collect()]


def test_cuts_nulls_empty_and_repeated_rows(spark):
    rows = [(1, 20, 3, "", ""), (2, None, 5, "", ""), (3, 0, 0, "", ""), (4, 3, 4, "", ""), (4, 3, 4, "", ""), (None, 1, 1, "", "")]
    got = run(spark, rows)
    by = {}
    for i, part, seq, start, n in got:
        by.setdefault(i, []).append((part, n))
    assert sorted(by[1]) == [(0, 10), (1, 10), (2, 3)]
    assert by[2] == [(0, 0)] and by[3] == [(0, 0)] and by[None] == [(0, 2)] and sorted(by[4]) == [(0, 7), (0, 7)]
    used = {}
    for _, _, seq, _, n in got:
        used[seq] = used.get(seq, 0) + n
    assert max(used.values()) <= 10 and sum(used.values()) == 39


def test_blocks_have_their_own_sequences(spark):
    rows = [(i, 3, 2, "", "") for i in range(101)]
    got = run(spark, rows, block_rows=20)
    used = {}
    for _, _, seq, _, n in got:
        used[seq] = used.get(seq, 0) + n
    assert max(used.values()) <= 10 and len(got) == 101 and len(used) <= 51 + 6
    assert sorted(got, key=str) == sorted(run(spark, rows, block_rows=20), key=str)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_totals_of_a_filling(spark):
    rows = [(i, i % 7, i % 5, "", "") for i in range(300)] + [(1000, 17, 8, "", "")]
    filled = fill_containers(spark.createDataFrame(rows, SCHEMA), F.col("query_len") + F.col("pos_len"), 10)
    r = filling_totals(filled, 10).first()
    assert (r["items"], r.tokens, r.wrongly_cut, r.overfull) == (301, sum(a + b for _, a, b, *_ in rows), 0, 0)
    assert filling_totals(filled.withColumn("seq_id", F.lit(0)), 10).first().overfull == 1
