import random
import re
import unicodedata
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import neardup as N

SCHEMA = "id bigint, ord bigint, text string"


def shingle_set(t, k):
    w = re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t).lower()) if t else []
    return len(w), frozenset(zip(*(w[i:] for i in range(k))))


def texts(rng, n, vocab):
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 60))) for _ in range(n)]
    out = list(base)
    for t in base:
        w = t.split()
        for _ in range(rng.randrange(0, 3)):
            v = list(w)
            for _ in range(rng.randrange(0, 6)):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            out.append(" ".join(v).upper() if rng.random() < 0.3 else "  ".join(v))
    return out


def brute(rows, k, t, least):
    sets = {i: s for i, x in rows for n, s in [shingle_set(x, k)] if n >= least and s}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) * t.denominator >= len(sets[a] | sets[b]) * t.numerator}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("k,t,hot,parts", [(3, 0.5, N.HOT_BUCKET, 1), (5, 0.8, N.HOT_BUCKET, 64), (2, 0.5, 3, 7)])
def test_random_texts_equal_brute_force(spark, k, t, hot, parts):
    rng = random.Random(k)
    rows = list(enumerate(texts(rng, 120, [chr(97 + i) * 2 for i in range(12)])))
    rows += [(900 + i, x) for i, (_, x) in enumerate(rows[:20])] + [(990, None), (991, ""), (992, "!!!"), (993, "one")]
    first = frame(spark, [(i, 5, x) for i, x in rows] + [(i, 4, "old text of this record " * 3) for i in range(5)] + [(None, 1, rows[0][1])])
    second = frame(spark, [(1, 9, "not a record of its own " * 5), (5000, 2, rows[3][1]), (5000, 1, "older"), (5001, None, rows[4][1])])
    want = brute(rows + [(5000, rows[3][1]), (5001, rows[4][1])], k, Fraction(str(t)), 4)
    r, owners = N.record_rows(first, second)
    pairs, members = N.similar_sets(r.repartition(3), width=k, threshold=t, least_words=4, hot_bucket=hot, parts=parts)
    rec = members.join(owners, "row_id").select("id", "set_hash").distinct().collect()
    by = {}
    for x in rec:
        by.setdefault(x.set_hash, []).append(x.id)
    got = {tuple(sorted((a, b))) for p in pairs.collect() for a in by.get(p.a, ()) for b in by.get(p.b, ()) if a != b}
    got |= {(a, b) for v in by.values() for a in v for b in v if a < b}
    assert len(want) > 50 and got == want


def test_records_and_classes(spark):
    a, b = "one two three four five six seven eight", "one two three four five six seven nine"
    rows = [(i, 1, a if i < 6 else b) for i in range(8)] + [(50, 1, None)]
    r, o = N.record_rows(frame(spark, rows), frame(spark, []))
    every = {tuple(x) for x in N.similar_records(r, o, width=3, threshold=0.5).collect()}
    assert every == {(x, y) for x in range(8) for y in range(x + 1, 8)}
    star = [tuple(x) for x in N.similar_records(r, o, width=3, threshold=0.5, expand=3).collect()]
    assert sorted(star) == [(0, i) for i in range(1, 8)] + [(6, 7)]
    classes = N.similar_classes(r, o, width=3, threshold=0.5)
    for expand in (1, 3, 5, 6):
        few = N.similar_records(r, o, width=3, threshold=0.5, expand=expand)
        assert {tuple(x) for x in N.all_pairs(few, classes, expand=expand).collect()} == every
    got = {tuple(x) for x in classes.collect()}
    assert got == {(i, 0, 6, 1) for i in range(6)} | {(i, 6, 2, 1) for i in (6, 7)}


def test_nothing_to_compare(spark):
    for rows in ([], [(1, 1, None)], [(1, 1, "a b c d e f")]):
        r, o = N.record_rows(frame(spark, rows), frame(spark, []))
        assert N.similar_records(r, o, width=3, threshold=0.5).collect() == []
        assert N.similar_classes(r, o, width=3, threshold=0.5).count() == len([x for x in rows if x[2]])


def forest_of(sets, t, tree, half):
    size = np.array([len(x) for x in sets])
    flat = np.array([(v * 0x9E3779B97F4A7C15) % (1 << 64) for x in sets for v in sorted(x)], np.uint64)
    great = size > N.WIDE
    wide = N._bits(flat[np.repeat(great, size)], size[great], N.WIDE_WORDS)
    o = np.lexsort((size, half, tree))
    return N.SignatureForest(N.Records(size, N._bits(flat, size), wide, t), o, tree[o], half[o])


@pytest.mark.parametrize("t", [Fraction(1, 2), Fraction(4, 5)])
def test_trees_lose_no_pair(t):
    rng = np.random.default_rng(0)
    sets = [frozenset(rng.integers(0, 60, rng.integers(1, 30)).tolist()) for _ in range(300)] + [frozenset(range(k, 400)) for k in range(0, 200, 9)]
    n = len(sets)
    tree, half = rng.integers(0, 5, n), np.full(n, 2)
    half[tree == 3] = np.arange((tree == 3).sum()) % 2
    f = forest_of(sets, t, tree, half)
    kept = {tuple(sorted((int(f.rec[a]), int(f.rec[b])))) for p, q in f.pairs() for a, b in zip(p, q)}
    like = lambda i, j: len(sets[i] & sets[j]) * t.denominator >= len(sets[i] | sets[j]) * t.numerator
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if tree[i] == tree[j] and (half[i] == 2 or half[i] != half[j]) and like(i, j)}
    assert len(want) > 20 and want <= kept
    assert f.visited > 0 and all(tree[i] == tree[j] and (half[i] == 2 or half[i] != half[j]) for i, j in kept)


def test_trees_prune_by_bits_and_sizes():
    far = [frozenset(range(k * 1000, k * 1000 + 20)) for k in range(4) for _ in range(64)]
    f = forest_of(far, Fraction(1, 2), np.zeros(256, int), np.full(256, 2))
    pairs = sum(len(p) for p, _ in f.pairs())
    assert pairs == 4 * 64 * 63 // 2 and f.pruned > 0 and f.compared < 256 * 255 // 2 * 0.6
    sizes = [frozenset(range(10 * 3**k)) for k in range(4) for _ in range(64)]
    f = forest_of(sizes, Fraction(1, 2), np.zeros(256, int), np.full(256, 2))
    assert sum(len(p) for p, _ in f.pairs()) == 4 * 64 * 63 // 2 and f.compared == 4 * 64 * 63 // 2


def test_a_text_goes_to_fewer_partitions_than_it_has_shingles():
    rng = np.random.default_rng(1)
    texts_ = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 80) % 5000) for _ in range(50)]
    h, per = N.words(texts_)
    w, c = np.unique(h, return_counts=True)
    common = N.Ranks(w, np.minimum(1 + np.log2(c) * 8, 255).astype(np.uint8))
    members, size, route = N.sets_of(h, per, 3, N._routes(h, per, 3, common, 255))
    ends = np.cumsum(size)
    routes = sum(len(np.unique(route[e - k : e])) for e, k in zip(ends, size))
    assert routes < 0.6 * len(members)
    # the route follows from the words alone
    again = N.sets_of(*N.words([texts_[7]]), 3, N._routes(*N.words([texts_[7]]), 3, common, 255))
    assert (again[2] == route[ends[6] : ends[7]]).all()
    hot = N.sets_of(h, per, 3, N._routes(h, per, 3, common, 1))[2]
    assert sum(len(np.unique(hot[e - k : e])) for e, k in zip(ends, size)) >= routes


def test_report_of_the_trees(spark):
    rng = random.Random(5)
    rows = list(enumerate(texts(rng, 150, [chr(97 + i) * 2 for i in range(6)])))
    got = N.search_report(spark.createDataFrame(rows, "row_id bigint, text string"), width=2, threshold=0.5, parts=2).collect()
    assert 1 <= len(got) <= 2 and all(r.records > 0 and r.visited > 0 and r.compared >= r.kept > 0 for r in got)


def test_equal_sets_have_equal_hashes():
    per, m, size = N.text_sets(["a b c d", "A  b, c d!", "d c b a", None, "a b"], 3)
    h = N.set_hash(m, size)
    assert per.tolist() == [4, 4, 4, 0, 2] and size.tolist() == [2, 2, 2, 0, 0]
    assert h[0] == h[1] != h[2] and Counter(h.tolist())[h[3]] == 2
