"""The N best items of every group, by merging sorted runs with a loser tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hits that a task holds before it writes a sorted run.
RUN_HITS = 1 << 20
#: Rows of input that a bucket of groups is meant for.
BUCKET_ROWS = 100_000

_RUN = "bucket int, groups array<string>, starts array<int>, items array<bigint>, scores array<double>"


def _spans(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """First position and length of each row's list in the flat values; null lists have length 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = col.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(off)
    if col.null_count:
        size = np.where(col.is_valid().to_numpy(zero_copy_only=False), size, 0)
    return off[:-1], size, col.values


def _hits(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Group of each row, and row, item and score of each hit that counts."""
    group, items, scores = (batch.column(i) for i in range(3))
    (io, isz, iv), (so, ssz, sv) = _spans(items), _spans(scores)
    n = np.minimum(isz, ssz)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    ip, sp = io[row] + at, so[row] + at
    ok = np.ones(len(row), bool)
    if iv.null_count:
        ok &= iv.is_valid().to_numpy(zero_copy_only=False)[ip]
        iv = pc.fill_null(iv, -1)
    item = iv.to_numpy(zero_copy_only=False)[ip]
    score = sv.to_numpy(zero_copy_only=False).astype(np.float64)[sp]  # nulls become NaN
    ok &= np.isfinite(score) & (item >= 0)
    return group, row[ok], item[ok], score[ok]


def _bucket_of(names: list[str], buckets: int) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(x) % buckets for x in names), np.int64, len(names))


def _write_run(parts: list, n: int, buckets: int) -> pa.RecordBatch:
    """One sorted run: per bucket a row whose hits are ordered by group, falling score and item.

    An item counts once per group with its highest score, and a group keeps at
    most n hits, so a hot group shrinks to n rows a run before the shuffle.
    """
    names = pa.concat_arrays([pa.array(g) for g, *_ in parts]).dictionary_encode()
    words = names.dictionary.to_pylist()
    rank = np.argsort(np.argsort(np.array(words, dtype=object), kind="stable"), kind="stable") if words else np.zeros(0, int)
    code = rank[names.indices.to_numpy(zero_copy_only=False)] if words else np.zeros(0, int)
    base = np.cumsum([0, *(len(g) for g, *_ in parts)])
    group = np.concatenate([code[r + b] for (_, r, _, _), b in zip(parts, base)])
    item = np.concatenate([p[2] for p in parts])
    score = np.concatenate([p[3] for p in parts]) + 0.0  # -0.0 and 0.0 are one score
    words = sorted(words)
    bucket = _bucket_of(words, buckets)
    # best score of each item of a group
    o = np.lexsort((-score, item, group))
    group, item, score = group[o], item[o], score[o]
    first = np.ones(len(o), bool)
    first[1:] = (group[1:] != group[:-1]) | (item[1:] != item[:-1])
    group, item, score = group[first], item[first], score[first]
    o = np.lexsort((item, -score, group, bucket[group]))
    group, item, score = group[o], item[o], score[o]
    new = np.ones(len(o), bool)
    new[1:] = group[1:] != group[:-1]
    begin = np.flatnonzero(new)
    keep = np.arange(len(o)) - np.repeat(begin, np.diff([*begin, len(o)])) < n
    group, item, score = group[keep], item[keep], score[keep]
    rows = []
    at = bucket[group]
    for b in np.unique(at):
        lo, hi = np.searchsorted(at, [b, b + 1])
        g = group[lo:hi]
        s = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        rows.append((int(b), [words[x] for x in g[s]], s.astype(np.int32), item[lo:hi], score[lo:hi]))
    cols = list(zip(*rows)) if rows else [[], [], [], [], []]
    kinds = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["bucket", "groups", "starts", "items", "scores"])


class LoserTree:
    """A tournament over k sorted runs; each step replays one path of log2(k) matches."""

    def __init__(self, heads: list):
        """heads: the first key of each run, None for an empty run."""
        self.k = max(1, len(heads))
        self.key = list(heads) or [None]
        self.loser = [-1] * self.k
        win = [0] * (2 * self.k)
        for i in range(self.k):
            win[self.k + i] = i
        for node in range(self.k - 1, 0, -1):
            a, b = win[2 * node], win[2 * node + 1]
            if self._less(b, a):
                a, b = b, a
            win[node], self.loser[node] = a, b
        self.top = win[1] if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.key[a], self.key[b]
        return x is not None and (y is None or x < y)

    def replace(self, key) -> None:
        """The winner's run goes on with key (None: it is at its end)."""
        keys, loser = self.key, self.loser
        w = self.top
        keys[w] = key
        node = (w + self.k) >> 1
        while node:
            x = loser[node]
            y = keys[x]
            if y is not None and (key is None or y < key):
                loser[node], w, key = w, x, y
            node >>= 1
        self.top = w


def merge_runs(runs: list[tuple[list, list, list, list]], n: int) -> Iterator[tuple[int, int, float, int]]:
    """(group, item, score, rank) of the n best items of every group of sorted runs.

    A run is (group codes ascending, start of each group, items, scores). Once a
    group has its n items, every run that still stands in it seeks to its next
    group instead of reading on.
    """
    pos, grp = [0] * len(runs), [0] * len(runs)

    def head(r: int):
        codes, starts, items, scores = runs[r]
        if grp[r] >= len(codes):
            return None
        p = pos[r]
        return (codes[grp[r]], -scores[p], items[p])

    tree = LoserTree([head(r) for r in range(len(runs))])
    now, seen, out = None, set(), 0
    while tree.key[tree.top] is not None:
        r = tree.top
        g, neg, item = tree.key[r]
        if g != now:
            now, seen, out = g, set(), 0
        codes, starts, items, scores = runs[r]
        if out < n and item not in seen:
            seen.add(item)
            out += 1
            yield g, item, -neg, out
        end = starts[grp[r] + 1] if grp[r] + 1 < len(starts) else len(items)
        pos[r] = end if out >= n else pos[r] + 1
        if pos[r] >= end:
            grp[r] += 1
        tree.replace(head(r))


def top_n_per_group(df: DataFrame, n: int = 10, *, group: str = "query_id", items: str = "doc_ids", scores: str = "scores", run_hits: int = RUN_HITS) -> DataFrame:
    """The n best items of every group: columns group (string), item (bigint), score (double), rank (int).

    Input rows hold a group and two parallel lists, items and scores; the hits of
    a group may lie in any number of rows. Places of the two lists belong
    together; where the lists differ in length the shorter one counts. Rows
    with a null group, null lists, hits with a null or negative item and hits
    whose score is null, NaN or infinite do not count. An item counts once per
    group with its highest score. Order: higher score, then smaller item. Empty
    input gives an empty result; other columns of df are not read.

    Each task writes sorted runs cut to n hits a group, the runs are shuffled by
    bucket of group, and each bucket merges its runs with a loser tree.
    """
    spark = df.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BUCKET_ROWS))
    src = df.select(F.col(group).alias("g"), F.col(items).alias("i"), F.col(scores).alias("s")).where("g is not null")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            if b.num_rows:
                parts.append(_hits(b))
                held += len(parts[-1][1])
            if held >= run_hits:
                yield _write_run(parts, n, buckets)
                parts, held = [], 0
        if held:
            yield _write_run(parts, n, buckets)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(i) for i in range(1, 5)))]
        if not rows:
            return
        names = pa.concat_arrays([r[0].values for r in rows])
        words = sorted(names.unique().to_pylist())
        code = {w: i for i, w in enumerate(words)}
        runs = [([code[x] for x in g.as_py()], s.values.to_pylist(), i.values.to_pylist(), v.values.to_pylist()) for g, s, i, v in rows]
        del rows
        kinds = {"group": pa.string(), "item": pa.int64(), "score": pa.float64(), "rank": pa.int32()}
        out: list = []

        def batch() -> pa.RecordBatch:
            g, i, s, k = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array([words[x] for x in g], pa.string()), pa.array(i, pa.int64()), pa.array(s, pa.float64()), pa.array(k, pa.int32())], list(kinds))

        for hit in merge_runs(runs, n):
            out.append(hit)
            if len(out) >= 50_000:
                yield batch()
                out = []
        if out:
            yield batch()

    runs = src.mapInArrow(write, _RUN)
    return runs.repartitionById(buckets, "bucket").mapInArrow(merge, "group string, item bigint, score double, rank int")
