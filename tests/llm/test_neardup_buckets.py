from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import neardup as N


@pytest.mark.parametrize("kind", [0, 2])
def test_buckets_of_both_kinds_under_one_name_lose_no_pair(kind):
    n = 256
    sets = [frozenset(range(i * 10, i * 10 + 5)) for i in range(n)]
    at = np.arange(n) % 3
    # the first posting has the given kind; two sets are alike within side 2, and two across 0 and 1
    side = np.array([2, 0, 1])[at] if kind == 2 else np.array([0, 2, 1])[at]
    (i, j), x, y = np.flatnonzero(side == 2)[5:7], np.flatnonzero(side == 0)[5], np.flatnonzero(side == 1)[9]
    sets[j], sets[y] = sets[i], sets[x]
    size = np.array([len(s) for s in sets])
    bits = N._bits(np.array([(v * 0x9E3779B97F4A7C15) % (1 << 64) for s in sets for v in sorted(s)], np.uint64), size)
    postings = np.sort(N.posting(np.full(n, 7), side, np.arange(n), np.ones(n, int)))
    got, _ = N.search_buckets(postings, N.Records(size, bits, np.zeros((0, N.WIDE_WORDS), np.uint64), Fraction(1, 2)))
    assert {(i, j), tuple(sorted((x, y)))} <= {divmod(int(p), n) for p in got}


def test_one_name_for_a_hot_and_a_plain_bucket_keeps_every_pair():
    # 100 + 100 records of the two halves of a block pair, and 50 of a plain bucket, all alike and under one name or two
    found = []
    for plain in (7, 8):
        side = np.repeat([0, 1, 2], [100, 100, 50])
        size = np.full(250, 5)
        bits = N._bits(np.tile(np.arange(5, dtype=np.uint64) << np.uint64(20), 250), size)
        postings = np.sort(N.posting(np.where(side == 2, plain, 7), side, np.arange(250), np.ones(250, int)))
        found.append(N.search_buckets(postings, N.Records(size, bits, np.zeros((0, N.WIDE_WORDS), np.uint64), Fraction(1, 2)))[0])
    assert len(found[0]) == 100 * 100 + 50 * 49 // 2 and (found[0] == found[1]).all()
