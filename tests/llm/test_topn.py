import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.topn import LoserTree, merge_runs, top_n_per_group

SCHEMA = "query_id string, doc_ids array<bigint>, scores array<double>, g int, bucket string"


def brute(rows, n):
    best = {}
    for g, items, scores, *_ in rows:
        if g is None or items is None or scores is None:
            continue
        for i, s in zip(items, scores):
            if i is None or i < 0 or s is None or not math.isfinite(s):
                continue
            best[g, i] = max(s, best.get((g, i), -math.inf))
    by = {}
    for (g, i), s in best.items():
        by.setdefault(g, []).append((-s, i))
    return {(g, i, -s, k + 1) for g, v in by.items() for k, (s, i) in enumerate(sorted(v)[:n])}


def run(spark, rows, n, **kw):
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], SCHEMA).repartition(3)
    return {tuple(r) for r in top_n_per_group(df, n, **kw).collect()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges_in_order(runs):
    runs = [sorted(r) for r in runs]
    at = [0] * len(runs)
    head = lambda r: runs[r][at[r]] if at[r] < len(runs[r]) else None
    t, out = LoserTree([head(r) for r in range(len(runs))]), []
    while t.key[t.top] is not None:
        out.append(t.key[t.top])
        at[t.top] += 1
        t.replace(head(t.top))
    assert out == sorted(x for r in runs for x in r)


def test_merge_seeks_past_a_finished_group():
    class Watched(list):
        seen = 0

        def __getitem__(self, i):
            Watched.seen += 1
            return super().__getitem__(i)

    run_ = ([0, 1], [0, 10_000], list(range(10_001)), Watched([1.0] * 10_000 + [0.5]))
    assert list(merge_runs([run_], 3)) == [(0, 0, 1.0, 1), (0, 1, 1.0, 2), (0, 2, 1.0, 3), (1, 10_000, 0.5, 1)]
    assert Watched.seen < 10


def test_random_tables_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(600):
        k = rng.randrange(0, 12)
        g = rng.choice([None, "hot", "hot", str(rng.randrange(30)), ""])
        items = [rng.choice([None, -3, rng.randrange(40)]) for _ in range(k)]
        scores = [rng.choice([None, math.nan, math.inf, -math.inf, 0.0, -0.0, round(rng.random(), 1)]) for _ in range(k)]
        rows.append((g, items, scores))
    rows += [("n", None, [1.0]), ("n", [1], None), ("n", [], []), ("short", [1, 2, 3], [0.5])] + rows[:50]
    for kw in ({}, {"run_hits": 50}):
        assert run(spark, rows, 5, **kw) == brute(rows, 5)


def test_empty_table(spark):
    assert run(spark, [], 3) == set()


@pytest.mark.parametrize("n", [1, 2])
def test_ties_go_to_the_smaller_item(spark, n):
    assert run(spark, [("q", [9, 4, 7], [1.0, 1.0, 1.0])], n) == {("q", 4, 1.0, 1), ("q", 7, 1.0, 2)} - ({("q", 7, 1.0, 2)} if n == 1 else set())
