"""Filling sequences of fixed capacity with examples of varying length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Examples that are packed together.
BLOCK_ROWS = 100_000
#: Lengths that are tried as the first of three before a gap counts as not exactly fillable.
_TRIES = 8


class SumIndex:
    """From a sum to one, two or three lengths that make it up, as far as there are items of them.

    pair and triple hold, for every sum up to the capacity, the greatest length
    that starts a combination of two or three (0: none). Items only run out, so
    what the index says is checked against the counts when it is used, and a
    combination that has run out is looked for among the lengths still there.
    """

    def __init__(self, counts: np.ndarray, cap: int):
        self.n, self.cap = counts.astype(np.int64).copy(), cap
        self.n[0] = 0
        self.build()

    def build(self) -> None:
        cap = self.cap
        self.there = self.n > 0
        lengths = np.flatnonzero(self.there)
        self.pair, self.triple = np.zeros(cap + 1, np.int32), np.zeros(cap + 1, np.int32)
        reach = np.zeros(cap + 1, bool)  # sums of two lengths up to x
        upto = 0
        for k, x in enumerate(lengths):
            two = x + lengths[: k + 1]
            if self.n[x] < 2:
                two = two[:-1]
            two = two[: np.searchsorted(two, cap, side="right")]
            self.pair[two] = x
            reach[two] = True
            upto = max(upto, int(two[-1]) if len(two) else 0)
            if upto:
                np.copyto(self.triple[x : x + upto + 1], x, where=reach[: min(upto, cap - x) + 1])
        self.stale = 0

    def take(self, lengths: list[int], times: int = 1) -> None:
        for x in lengths:
            self.n[x] -= times
            if self.n[x] <= 0:
                self.there[x] = False

    def give(self, lengths: list[int]) -> None:
        for x in lengths:
            self.n[x] += 1
            self.there[x] = True

    def largest(self, most: int) -> int:
        """The greatest length there is, up to most; 0 if none."""
        if most <= 0:
            return 0
        at = int(self.there[most:0:-1].argmax())
        return most - at if self.there[most - at] else 0

    def two(self, total: int, most: int) -> tuple[int, int] | None:
        """Two items of the given sum, the greater one as great as can be, none above most."""
        lo, hi = (total + 1) // 2, min(most, total - 1)
        if hi < lo:
            return None
        x = int(self.pair[total])
        if lo <= x <= hi and self.there[x] and self.there[total - x] and (2 * x != total or self.n[x] > 1):
            return x, total - x
        ok = self.there[lo : hi + 1] & self.there[total - hi : total - lo + 1][::-1]
        if 2 * lo == total and self.n[lo] < 2:
            ok[0] = False
        at = int(ok[::-1].argmax())
        return (hi - at, total - hi + at) if ok[len(ok) - 1 - at] else None

    def three(self, total: int, most: int) -> tuple[int, int, int] | None:
        """Three items of the given sum, found from the greatest down."""
        x = min(int(self.triple[total]), most)
        for _ in range(_TRIES):
            x = self.largest(x)
            if 3 * x < total or not x:
                return None
            if self.pair[total - x]:
                self.n[x] -= 1
                two = self.two(total - x, x) if self.n[x] or total - x != x else None
                if two and self.n[x] == 0 and x in two:
                    two = None
                self.n[x] += 1
                if two:
                    return (x, *two)
            x -= 1
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three items that fill gap exactly."""
        if self.there[gap]:
            return (gap,)
        got = (self.two(gap, gap) if self.pair[gap] else None) or (self.three(gap, gap) if self.triple[gap] else None)
        if not got and (self.pair[gap] or self.triple[gap]):
            self.stale += 1
        return got


def plan_patterns(counts: np.ndarray, cap: int) -> list[tuple[list[int], int]]:
    """Fillings as (lengths, how many sequences have them) for counts[length] items of each length.

    From the longest item down, a gap is closed by the one, two or three items
    whose lengths add up to it exactly; while nothing does, the longest item
    that fits goes in. Each filling is used as often as its scarcest length
    allows, so the number of fillings follows the number of lengths, not of
    items. What no exact filling takes goes by best fit, in the order in which
    it came up, so that the short items are still there for it. Exact fillings
    may use up items that best fit would have used better: of the fillings
    with exact combinations and without, those with fewer sequences are taken.
    """
    def sequences(plan: list[tuple[list[int], int]]) -> int:
        return sum(times for _, times in plan)

    exact = _exact_fillings(counts, cap)
    if sequences(exact) == -(-int((np.arange(cap + 1) * counts).sum()) // cap):
        return exact
    return min((exact, _best_fit(counts, cap)), key=sequences)


def _exact_fillings(counts: np.ndarray, cap: int) -> list[tuple[list[int], int]]:
    index = SumIndex(counts, cap)
    done: list[tuple[list[int], int]] = []
    top, patience = cap, 256
    while length := index.largest(top):
        top = length
        index.take([length])
        fill, gap = [length], cap - length
        while gap:
            if rest := index.exact(gap):
                fill += rest
                index.take(list(rest))
                gap = 0
                break
            if not (x := index.largest(gap)):
                break
            index.take([x])
            fill.append(x)
            gap -= x
        index.give(fill)
        kinds, k = np.unique(fill, return_counts=True)
        times = int((index.n[kinds] // k).min())
        if gap:
            times = 1
        for x, m in zip(kinds.tolist(), k.tolist()):
            index.take([x], m * times)
        done.append((fill, times))
        if index.stale > patience:
            index.build()
            patience *= 16
    return done


def _best_fit(counts: np.ndarray, cap: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first; sequences with the same content are handled together."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    free = np.zeros(cap + 1, bool)
    done: list[tuple[list[int], int]] = []
    for length in (np.flatnonzero(counts[1:])[::-1] + 1).tolist():
        n = int(counts[length])
        while n:
            at = int(free[length:].argmax())
            gap = length + at
            if not free[gap]:
                each = cap // length
                full, rest = divmod(n, each)
                for size, times in ((each, full), (rest, 1)):
                    if size and times:
                        open_.setdefault(cap - size * length, {})[(length,) * size] = times
                        free[cap - size * length] = True
                break
            content, times = next(iter(open_[gap].items()))
            fit = min(gap // length, n)
            use = min(times, max(1, n // fit))
            open_[gap][content] -= use
            if not open_[gap][content]:
                del open_[gap][content]
                if not open_[gap]:
                    del open_[gap]
                    free[gap] = False
            new, left = content + (length,) * fit, gap - fit * length
            to = open_.setdefault(left, {})
            to[new] = to.get(new, 0) + use
            free[left] = left > 0
            n -= fit * use
    return done + [(list(c), t) for by in open_.values() for c, t in by.items()]


def assign(lengths: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and start of each item (0 <= length <= cap); empty items lie at the start of sequence 0."""
    plan = plan_patterns(np.bincount(lengths, minlength=cap + 1), cap)
    by_length: dict[int, list[np.ndarray]] = {}
    by_start: dict[int, list[np.ndarray]] = {}
    base = 0
    for fill, times in plan:
        seq, start = np.arange(base, base + times), 0
        for x in sorted(fill, reverse=True):
            by_length.setdefault(x, []).append(seq)
            by_start.setdefault(x, []).append(np.full(times, start, np.int32))
            start += x
        base += times
    order = np.argsort(lengths, kind="stable")
    seq, begin = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int32)
    edge = np.searchsorted(lengths[order], np.arange(cap + 2))
    for x, got in by_length.items():
        at = order[edge[x] : edge[x + 1]]
        seq[at], begin[at] = np.concatenate(got), np.concatenate(by_start[x])
    return seq, begin


def filling_totals(filled: DataFrame, capacity: int = 2048, *, item: str = "example_id") -> DataFrame:
    """One row on a filling: items, tokens, sequences that hold too much or overlap, and items that were cut though they fit."""
    # all parts of a cut item but its last fill a sequence
    wrong = (F.col("part") > 0) & (F.col("length") < 1)
    by = filled.groupBy("seq_id").agg(
        F.count(F.when(F.col("part") == 0, 1)).alias("items"),
        F.sum("length").alias("used"),
        F.max(F.col("start") + F.col("length")).alias("reach"),
        F.count(F.when(wrong, 1)).alias("wrong"),
    )
    over = (F.col("used") > capacity) | (F.col("reach") != F.col("used"))
    return by.agg(F.sum("items").alias("items"), F.sum("used").cast("bigint").alias("tokens"), F.sum("wrong").alias("wrongly_cut"), F.count(F.when(over, 1)).alias("overfull"))


def fill_containers(df: DataFrame, length: Column, capacity: int = 2048, *, item: str = "example_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Put items into containers of fixed capacity with as little unused room as possible.

    Returns (item bigint, part int, seq_id bigint, start int, length int): the
    container of each item and its place there. An item longer than the capacity
    is cut into parts 0, 1, ... of which all but the last fill a container; any
    other item has the one part 0. A null or negative length counts as 0; an
    item of length 0 gets a container and takes no room. Every row counts, also
    repeated ones and those with a null item; an empty table gives an empty
    result. Extra columns are not read.

    Rows are spread evenly over blocks of about block_rows (no key, so nothing is
    skewed) and each block is planned from its counts by length, so the work of
    a task is bounded and one narrow shuffle is all that moves. Each block may
    leave a sequence or so more than the whole table would.
    """
    n = df.count()
    blocks = max(1, -(-n // block_rows))
    slim = df.select(F.col(item).cast("bigint").alias("item"), F.greatest(F.coalesce(length.cast("bigint"), F.lit(0)), F.lit(0)).alias("len"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("item", "ascending"), ("len", "ascending")])
        size = t["len"].to_numpy()
        full, rest = size // capacity, size % capacity
        parts = full + ((rest > 0) | (size == 0))
        row = np.repeat(np.arange(len(size)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        length_ = np.where(part < full[row], capacity, rest[row])
        seq, start = assign(length_, capacity)
        seq += TaskContext.get().partitionId() << 40
        out = pa.Table.from_arrays([t["item"].combine_chunks().take(pa.array(row)), pa.array(part, pa.int32()), pa.array(seq), pa.array(start, pa.int32()), pa.array(length_, pa.int32())], ["item", "part", "seq_id", "start", "length"])
        yield from out.to_batches(max_chunksize=65_536)

    packed = slim.repartition(blocks).mapInArrow(pack, "item bigint, part int, seq_id bigint, start int, length int")
    return packed.withColumnRenamed("item", item)
