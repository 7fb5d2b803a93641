import random
import re
import unicodedata

import numpy as np
import pytest

from tessera.llm.leaks import Shard, leaked_items, match_passages, pack_lists, place_words, split_passages, store_index, unpack_lists


def words(t):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t).lower()) if t else []


def brute(docs, items, width):
    at = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - width + 1):
            at.setdefault(tuple(w[k : k + width]), set()).add(i)
    return {(d, i) for d, t in docs for k in range(len(words(t)) - width + 1) for i in at.get(tuple(words(t)[k : k + width]), ())}


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, 1, "i") for x in docs], "doc_id bigint, text string, item_id int, item string")
    i = spark.createDataFrame([(*x, 1, "d") for x in items], "item_id bigint, text string, doc_id int, doc string")
    rows = [tuple(r) for r in leaked_items(d, i, **kw).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(2)
    vocab = ["the"] * 5 + list("abcdefg")
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randrange(2, 30))) for i in range(25)] + [(98, None), (99, "")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    docs += [(100 + i, "x, y! " + t.upper() + " z") for i, t in items[:10]] + [(200, None), (201, ""), (None, items[0][1])] + docs[:5]
    want = brute(docs, items, 6)
    assert len(want) > 20
    assert run(spark, docs, items, width=6) == want
    assert run(spark, docs, items, width=6, broadcast_bytes=0, vocabulary=0) == want


def test_a_passage_does_not_reach_over_two_documents(spark):
    item = "one two three four five six"
    assert run(spark, [(1, "one two three"), (2, "four five six")], [(1, item)], width=6) == set()
    assert run(spark, [(1, "ＯＮＥ two-three;four\nfive_six")], [(1, item)], width=6) == {(1, 1)}


def shard_of(texts, gap=20):
    h, at, start = place_words(texts, gap)
    terms = np.unique(h)
    head = __import__("zlib").compress(np.concatenate([np.arange(len(texts)), start, np.ones(len(texts), np.int64)]).astype(np.int64).tobytes())
    return Shard(head, terms.view(np.int64), [pack_lists(at[h == t], np.zeros(1, int))[0] for t in terms])


def test_proximity_takes_moved_words():
    passage = place_words(["alpha beta gamma delta"], 0)[0].view(np.int64)
    docs = ["alpha beta gamma delta", "alpha beta new gamma delta", "alpha beta x y z gamma delta", None, "gamma delta", "alpha beta"]
    shard = shard_of(docs)
    for anchor in range(4):
        hits = lambda slop: set(match_passages(shard, [(passage, anchor)], 4, slop)[0].tolist())
        assert hits(0) == {0} and hits(1) == {0, 1} and hits(3) == {0, 1, 2}


def brute_near(docs, items, width, slop):
    """Windows whose words all stand within slop of their place beside some occurrence of the anchor word."""
    n = {}
    for _, t in docs:
        for w in words(t):
            n[w] = n.get(w, 0) + 1
    out = set()
    for i, t in items:
        v = words(t)
        for k in range(len(v) - width + 1):
            win = v[k : k + width]
            if not all(w in n for w in win):
                continue
            a = min(range(width), key=lambda x: n[win[x]])
            for d, text in docs:
                u = words(text)
                for p in (p for p, w in enumerate(u) if w == win[a]):
                    if all(x == a or win[x] in u[max(0, p + x - a - slop) : max(0, p + x - a + slop + 1)] for x in range(width)):
                        out.add((d, i))
    return out


@pytest.mark.parametrize("slop", [1, 2])
def test_proximity_equals_brute_force_and_stays_in_its_document(spark, slop):
    rng = random.Random(slop)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnopqr") for _ in range(n))
    items = [(i, text(12)) for i in range(6)]
    docs = [(i, text(40)) for i in range(30)]
    for i, t in items:
        v = t.split()
        v.insert(rng.randrange(3, 9), "new")
        docs.append((100 + i, text(5) + " " + " ".join(v) + " " + text(5)))
    docs += [(200, " ".join(items[0][1].split()[:6])), (201, " ".join(items[0][1].split()[6:]))]
    got = run(spark, docs, items, width=8, slop=slop)
    assert got == brute_near(docs, items, 8, slop) and len(got) >= 3 and not {d for d, _ in got} & {200, 201}


def test_passages_cover_every_window():
    rng = np.random.default_rng(0)
    for n in (0, 3, 4, 5, 60):
        terms, total = rng.integers(0, 9, n), rng.integers(0, 30, n)
        got = split_passages(terms, total, 4)
        windows = {k for a, z, _ in got for k in range(a, z - 3)}
        assert windows == {k for k in range(n - 3) if total[k : k + 4].min() > 0}
        assert all(total[x] == total[k : k + 4].min() and k <= x < k + 4 for a, z, x in got for k in range(a, z - 3))


def test_the_index_has_every_place(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (None, "b"), (3, None), (4, "c " * 500)], "doc bigint, text string").coalesce(1)
    index = store_index(docs, f"{tmp_path}/index", gap=10)
    rows = {r.term: unpack_lists([r.places])[0].tolist() for r in index.collect() if r.term is not None}
    h = dict(zip("abc", place_words(["a b c"], 0)[0].view(np.int64).tolist()))
    assert rows == {h["a"]: [0, 2], h["b"]: [1, 13], h["c"]: [34 + i for i in range(500)]}
    few = store_index(docs, f"{tmp_path}/few", vocabulary=np.array([h["b"]]).view(np.uint64), gap=10)
    assert {r.term for r in few.collect()} == {None, h["b"]}
    assert spark.read.parquet(f"{tmp_path}/few").count() == 2


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")], width=2) == set()
    assert run(spark, [(1, "a b c")], [], width=2) == set()


def test_lists_of_places_survive_packing():
    rng = np.random.default_rng(0)
    lists = [np.cumsum(rng.integers(0, 1 << int(b), n)) for b, n in zip(rng.integers(0, 40, 60), rng.integers(1, 50, 60))]
    first = np.cumsum([0, *map(len, lists)])[:-1]
    packed = pack_lists(np.concatenate(lists), first)
    places, n = unpack_lists(packed)
    assert n.tolist() == [len(x) for x in lists] and places.tolist() == np.concatenate(lists).tolist()
    assert unpack_lists([])[0].tolist() == [] and [len(x) for x in pack_lists(np.array([3, 130, 131]), np.zeros(1, int))] == [3]
