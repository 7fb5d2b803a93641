"""Near-duplicate texts by signature trees over prefix buckets.

Which pairs are looked at is decided without loss: two sets whose Jaccard
similarity is at least t share a member in short prefixes of theirs when both
are ordered alike (the less common members first). Every such member is a bucket, and a
bucket is searched by signature tree.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import mix, shingles, words
from tessera.session import cut

#: Bits of a shingle hash that a bucket goes by; two shingles of one bucket only ever cost a look at a pair.
HASH_BITS = 44
#: 64-bit words of a signature, and of the second signature that sets of more than WIDE members have.
SIG_WORDS, WIDE_WORDS = 3, 8
WIDE = 128
#: Children of a node of a signature tree.
FANOUT = 4
#: Shingles and words whose frequency is kept, the commonest; the order of the others is that of their hashes.
LISTED, LISTED_WORDS = 1 << 20, 1 << 16
#: Shingles whose frequencies are added up at a time.
COUNT_TOKENS = 1 << 22
#: A bucket that may hold more records is cut into blocks that are searched pairwise in other tasks.
HOT_BUCKET = 20_000
#: Characters of text that a search partition is meant for.
PART_CHARS = 8 << 20
#: Bits (as powers of two) that the filter of candidate rows has at least and at most; it holds 16 a row up to there.
FILTER_BITS = (16, 29)
#: Texts that are read together, and pairs that are compared together.
_BLOCK, _CHUNK = 4096, 1 << 20

_U = np.uint64


# --- sets ------------------------------------------------------------------


def sets_of(h: np.ndarray, per: np.ndarray, width: int, route: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(members of all sets one after the other, size of each set, route of each member) for texts of `per` words with hashes h."""
    s, at = shingles(h, per, width)
    key = (at.astype(_U) << _U(HASH_BITS)) | (s >> _U(64 - HASH_BITS))
    o = np.argsort(key)
    key, s = key[o], s[o]
    same = key[1:] == key[:-1]
    if (same & (s[1:] != s[:-1])).any():  # two shingles of a text with one bucket
        o = np.lexsort((shingles(h, per, width)[0], at))
        s = shingles(h, per, width)[0][o]
        key = (at[o].astype(_U) << _U(HASH_BITS)) | (s >> _U(64 - HASH_BITS))
        same = (key[1:] == key[:-1]) & (s[1:] == s[:-1])
    first = np.r_[True, ~same] if len(s) else np.zeros(0, bool)
    doc = (key[first] >> _U(HASH_BITS)).astype(np.int64)
    return s[first], np.bincount(doc, minlength=len(per)), None if route is None else route[o][first]


def text_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, members of all sets one after the other, size of each set): sets of shingle hashes, ascending."""
    h, per = words(texts)
    members, size, _ = sets_of(h, per, width)
    return per, members, size


def set_hash(members: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; equal sets have equal hashes."""
    if not len(members):
        return np.zeros(len(size), np.int64)
    first = np.cumsum(size) - size
    total = np.zeros(len(size), _U)
    some = size > 0
    total[some] = np.add.reduceat(mix(members * _U(0x9E3779B97F4A7C15) + _U(1)), first[some])
    return mix(total ^ size.astype(_U)).view(np.int64)


def _bits(members: np.ndarray, size: np.ndarray, words_: int = SIG_WORDS) -> np.ndarray:
    """The OR-combined member bits of each set, as rows of 64-bit words."""
    out = np.zeros((len(size), words_ * 64), bool)
    at = ((members >> _U(64 - HASH_BITS)) % _U(words_ * 64)).astype(np.int64)
    out[np.repeat(np.arange(len(size)), size), at] = True
    return np.packbits(out, axis=1, bitorder="little").view(_U)


class Ranks:
    """How common listed keys are: 1 + 8 log2(count), at most 255; 0 for all other keys."""

    def __init__(self, keys: np.ndarray, rank: np.ndarray):
        o = np.argsort(keys)
        self.keys, self.rank = keys[o], rank[o]
        # keys are spread evenly, so their first bits lead to a stretch of a key or two
        bits = max(1, len(keys).bit_length())
        self.shift = _U(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=_U)).astype(np.int32)

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint8)
        if not len(self.keys):
            return out
        at = (h >> self.shift).astype(np.int64)
        lo, hi = self.first[at], self.first[at + 1]
        open_ = np.flatnonzero(lo < hi)
        lo, hi = lo[open_], hi[open_]
        while len(open_):
            same = self.keys[lo] == h[open_]
            out[open_[same]] = self.rank[lo[same]]
            lo = lo + 1
            go = ~same & (lo < hi)
            open_, lo, hi = open_[go], lo[go], hi[go]
        return out


def _routes(h: np.ndarray, per: np.ndarray, width: int, common: Ranks, hot_rank: int) -> np.ndarray:
    """Where each shingle is searched: a hash of its rarest word, or of its two rarest where that one is hot.

    Neighbouring shingles share their rarest word mostly, so a text goes to far
    fewer partitions than it has shingles.
    """
    text = np.repeat(np.arange(len(per)), per)
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    ok = text[:n] == text[width - 1 :]
    key = (common.of(h).astype(_U) << _U(56)) | (mix(h) >> _U(8))
    one, two = key[:n][ok], np.full(int(ok.sum()), np.iinfo(np.uint64).max, _U)
    for i in range(1, width):
        k = key[i : i + n][ok]
        two = np.where(k < one, one, np.where(k > one, np.minimum(two, k), two))
        one = np.minimum(one, k)
    hot = (one >> _U(56)) >= hot_rank
    return mix(np.where(hot, one * _U(0x9E3779B97F4A7C15) + two, one))


# --- signature trees ---------------------------------------------------------


def _least_overlap(total: np.ndarray, t: Fraction) -> np.ndarray:
    """Members that two sets of `total` members together must share at least."""
    n, d = t.numerator, t.numerator + t.denominator
    return -(-total * n // d)


class Records:
    """Sizes and signatures of sets, and what two of them may share at most."""

    def __init__(self, size: np.ndarray, bits: np.ndarray, wide: np.ndarray, t: Fraction):
        self.size, self.bits, self.t = size.astype(np.int32), np.ascontiguousarray(bits), t
        self.words = [np.ascontiguousarray(w) for w in bits.T]
        self.surplus = self.size - np.bitwise_count(bits).sum(axis=1).astype(np.int32)
        self.wide, self.wide_at = wide, np.cumsum(size > WIDE) - 1
        self.wide_surplus = self.size[size > WIDE] - np.bitwise_count(wide).sum(axis=1).astype(np.int32)
        self.need = _least_overlap(np.arange(2 * int(size.max(initial=0)) + 1), t).astype(np.int32)

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether signatures and sizes allow a similar pair."""
        common = np.bitwise_count(self.words[0][i] & self.words[0][j]).astype(np.int32)
        for w in self.words[1:]:
            common += np.bitwise_count(w[i] & w[j])
        sa, sb = self.size[i], self.size[j]
        most = np.minimum(np.minimum(self.surplus[i], self.surplus[j]) + common, np.minimum(sa, sb))
        ok = (most >= self.need[sa + sb]) & (most.astype(np.int64) * self.t.denominator >= np.maximum(sa, sb).astype(np.int64) * self.t.numerator)
        # the first signature says little of great sets
        both = np.flatnonzero(ok & (sa > WIDE) & (sb > WIDE))
        if len(both):
            a, b = self.wide_at[i[both]], self.wide_at[j[both]]
            most = np.bitwise_count(self.wide[a] & self.wide[b]).sum(axis=1) + np.minimum(self.wide_surplus[a], self.wide_surplus[b])
            ok[both] = most >= self.need[sa[both] + sb[both]]
        return ok


class SignatureForest:
    """A signature tree for every group of records of a partition, all built and traversed together.

    A node has the OR of its records' bits, the range of their sizes and their
    greatest surplus (size less number of bits: members that share a bit).
    Level 0 has the records of the groups, ordered by size within a group; a
    node of a further level combines FANOUT neighbours. Groups come in pairs:
    a group is compared within itself (partner: itself) or with its partner.
    """

    def __init__(self, records: Records, rec: np.ndarray, tree: np.ndarray, half: np.ndarray):
        """rec: record of each item, items ascending by (tree, half, place); a tree with items of both
        halves (0, 1) compares those with each other, one of half 2 alone within itself."""
        self.r, self.rec = records, rec
        self.visited = self.pruned = self.compared = 0
        #: per level: bits, least and greatest size, surplus, first child, children
        self.levels: list[tuple] = [()]
        self.start: list[tuple[np.ndarray, np.ndarray]] = []
        node = (records.bits[rec], records.size[rec], records.size[rec], records.surplus[rec])
        group = tree.astype(np.int64) * 4 + half
        at = np.arange(len(rec))
        while True:
            new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
            count = np.diff(np.r_[new, len(group)])
            own = group[new] >> 2
            # a tree is done when no half of it has more than one node
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
            most = np.maximum.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
            halves = np.diff(np.r_[first, len(own)])
            done = most == 1
            a = at[new[first[done]]]
            b = np.where(halves[done] == 2, at[new[np.minimum(first[done] + 1, len(new) - 1)]], a) if len(a) else a
            single = (halves[done] == 2) | ((group[new[first[done]]] & 3) == 2) if len(a) else np.zeros(0, bool)
            self.start.append((a[single], b[single]))
            live = np.repeat(np.repeat(~done, halves), count)
            if not live.any():
                break
            group, at = group[live], at[live]
            node = tuple(v[live] for v in node)
            new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            count = np.diff(np.r_[new, len(group)])
            edge = np.flatnonzero((np.arange(len(group)) - np.repeat(new, count)) % FANOUT == 0)
            kids = np.diff(np.r_[edge, len(group)])
            bits, lo, hi, sur = node
            node = (np.bitwise_or.reduceat(bits, edge, axis=0), np.minimum.reduceat(lo, edge), np.maximum.reduceat(hi, edge), np.maximum.reduceat(sur, edge))
            self.levels.append((*node, at[edge], kids))
            group, at = group[edge], np.arange(len(edge))

    def _may(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the greatest overlap that records of two nodes could have reaches what their smallest would need."""
        bits, lo, hi, sur, _, _ = self.levels[level]
        t = self.r.t
        most = np.minimum(np.minimum(hi[x], hi[y]), np.bitwise_count(bits[x] & bits[y]).sum(axis=1) + np.minimum(sur[x], sur[y]))
        # a record of size m shares at least t * (its partner's size) members with it
        least = np.maximum(lo[x], lo[y]).astype(np.int64)
        need = np.maximum(_least_overlap(lo[x].astype(np.int64) + lo[y], t), -(-least * t.numerator // t.denominator))
        return most >= need

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of items whose records' signatures allow a similar pair, in pieces of bounded size: dual traversal from the roots down."""
        stack = [(level, x, y) for level, (x, y) in enumerate(self.start) if level and len(x)]
        flat = self.start[0]
        if len(flat[0]):  # trees of one record on either side
            stack.append((0, *flat))
        while stack:
            level, x, y = stack.pop()
            if level == 0:
                ok = x != y
                x, y = x[ok], y[ok]
                for lo in range(0, len(x), _CHUNK):
                    p, q = x[lo : lo + _CHUNK], y[lo : lo + _CHUNK]
                    self.compared += len(p)
                    ok = self.r.alike(self.rec[p], self.rec[q])
                    if ok.any():
                        yield p[ok], q[ok]
                continue
            *_, child, kids = self.levels[level]
            size = kids[x] * kids[y]
            cut_at = int(np.searchsorted(np.cumsum(size), _CHUNK)) + 1
            if cut_at < len(x):
                stack.append((level, x[cut_at:], y[cut_at:]))
                x, y, size = x[:cut_at], y[:cut_at], size[:cut_at]
            self.visited += len(x)
            other = np.flatnonzero(x != y)  # a node may always hold a pair with itself
            keep = np.ones(len(x), bool)
            keep[other] = self._may(level, x[other], y[other])
            self.pruned += int((~keep).sum())
            x, y, size = x[keep], y[keep], size[keep]
            if not len(x):
                continue
            own = np.repeat(x == y, size)
            nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            wide = np.repeat(kids[y], size)
            i, j = nth // wide, nth % wide
            keep = ~own | (i <= j)
            stack.append((level - 1, (np.repeat(child[x], size) + i)[keep], (np.repeat(child[y], size) + j)[keep]))


def search_buckets(postings: np.ndarray, records: Records) -> tuple[np.ndarray, SignatureForest]:
    """(candidate pairs of records as i * n + j with i < j, the forest with its counts).

    A posting (see posting) is a bucket, a side (0 and 1: compared with each
    other only; 2: all within), a record and inner, whether the bucket lies in
    the record's short prefix; postings are ascending. Buckets of both kinds
    may share a name and are then two trees.
    """
    n = len(records.size)
    side = ((postings >> _U(33)) & _U(3)).astype(np.int64)
    tree = ((postings >> _U(35)) << _U(1)).astype(np.int64) | (side == 2)
    inner = (postings & _U(1)).astype(bool)
    new = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if len(tree) else np.zeros(0, np.int64)
    if len(new):  # of a similar pair the smaller set comes by its short prefix, so a bucket needs such a posting, and two
        count = np.diff(np.r_[new, len(tree)])
        live = np.repeat((count > 1) & np.logical_or.reduceat(inner, new), count)
        postings, side, tree, inner = postings[live], side[live], tree[live], inner[live]
    rec = ((postings >> _U(1)) & _U(0xFFFFFFFF)).astype(np.int64)
    forest = SignatureForest(records, rec, tree, side)
    out: list[np.ndarray] = []
    held = 0
    for p, q in forest.pairs():
        i, j = rec[p], rec[q]
        sa, sb = records.size[i], records.size[j]
        ok = ((inner[p] & (sa <= sb)) | (inner[q] & (sb <= sa))) & (i != j)
        i, j = i[ok], j[ok]
        if len(i):
            out.append(np.unique(np.minimum(i, j) * n + np.maximum(i, j)))
            held += len(out[-1])
            if held > 4 * max(_CHUNK, len(out[0])):  # a pair meets in many buckets
                out = [np.unique(np.concatenate(out))]
                held = len(out[0])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64), forest


# --- stages ------------------------------------------------------------------


class _Counter:
    """Frequencies of keys in parts of bounded size; what occurs once in a part is not passed on."""

    def __init__(self, slices: int):
        self.slices, self.held, self.n = slices, ([], []), 0

    def add(self, tokens: np.ndarray, words_: np.ndarray) -> None:
        self.held[0].append(tokens)
        self.held[1].append(words_)
        self.n += len(tokens)

    def flush(self) -> list[tuple[int, bytes]]:
        """(2 * slice + kind, keys and counts as bytes) of what is held."""
        out = []
        for kind, got in enumerate(self.held):
            key, count = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, _U), np.zeros(0, np.int64))
            key, count = key[count > 1], count[count > 1].astype(np.uint32)
            at = (key % _U(self.slices)).astype(np.int64)
            o = np.argsort(at, kind="stable")
            edge = np.searchsorted(at[o], np.arange(self.slices + 1))
            for s in np.flatnonzero(np.diff(edge)):
                pick = o[edge[s] : edge[s + 1]]
                out.append((int(2 * s + kind), key[pick].tobytes() + count[pick].tobytes()))
        self.held, self.n = ([], []), 0
        return out


def _profile(rows: DataFrame, width: int, least: int, slices: int) -> DataFrame:
    """(row_id, n, set_hash) of every row with at least `least` words, and (slice, counts) of its shingles and words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row_id", "n", "set_hash", "slice", "counts"]
        counter = _Counter(slices)

        def counts() -> Iterator[pa.RecordBatch]:
            got = counter.flush()
            if got:
                none = pa.nulls(len(got), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.nulls(len(got), pa.int32()), none, pa.array([s for s, _ in got], pa.int32()), pa.array([b for _, b in got], pa.binary())], names)

        for whole in batches:
            for lo in range(0, whole.num_rows, _BLOCK):
                b = whole.slice(lo, _BLOCK)
                w, n = words(b.column(1).to_pylist())
                members, size, _ = sets_of(w, n, width)
                h = set_hash(members, size)
                kept = n >= least
                fit = np.flatnonzero(kept & (size > 0))
                one = np.zeros(len(h), bool)
                one[fit[np.unique(h[fit], return_index=True)[1]]] = True  # copies count once
                counter.add(members[np.repeat(one, size)], w[np.repeat(one, n)])
                k = int(kept.sum())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.flatnonzero(kept))), pa.array(size[kept], pa.int32()), pa.array(h[kept]), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names
                )
                if counter.n > COUNT_TOKENS:
                    yield from counts()
        yield from counts()

    return cut(rows.mapInArrow(scan, "row_id bigint, n int, set_hash bigint, slice int, counts binary"))


def _common(counts: DataFrame, slices: int) -> tuple[Ranks, Ranks]:
    """Ranks of shingles and of words: of each slice the commonest, so that what is sent has a fixed bound."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1)):
                m = len(x.as_buffer()) // 12
                buf = memoryview(x.as_buffer())
                held.setdefault(s, []).append((np.frombuffer(buf, _U, m), np.frombuffer(buf, np.uint32, m, 8 * m)))
        for s, got in held.items():
            key, back = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
            count = np.bincount(back, weights=np.concatenate([c for _, c in got]))
            most = max(1, (LISTED_WORDS if s % 2 else LISTED) // slices)
            if len(key) > most:
                top = np.argpartition(-count, most - 1)[:most]
                key, count = key[top], count[top]
            rank = np.minimum(1 + np.log2(count) * 8, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([s % 2], pa.int32()), pa.array([key.tobytes()], pa.binary()), pa.array([rank.tobytes()], pa.binary())], ["kind", "keys", "ranks"])

    part = F.floor(F.col("slice") / 2).cast("int")
    got = counts.withColumn("at", part).repartitionById(slices, "at").select("slice", "counts").mapInArrow(add_up, "kind int, keys binary, ranks binary").collect()

    def ranks(kind: int) -> Ranks:
        mine = [r for r in got if r.kind == kind]
        return Ranks(np.frombuffer(b"".join(r["keys"] for r in mine), _U), np.frombuffer(b"".join(r["ranks"] for r in mine), np.uint8))

    return ranks(0), ranks(1)


def _postings(rows: DataFrame, common: tuple[Ranks, Ranks], width: int, least: int, t: Fraction, parts: int, hot: int, hot_word: int) -> DataFrame:
    """(part, blob): each task's records with their prefix members, packed by search partition."""
    sent = rows.sparkSession.sparkContext.broadcast(common)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words_ = sent.value
        blocks_of = np.maximum(1, np.ceil(2.0 ** (np.arange(256) / 8) / hot)).astype(np.int64)
        blocks_of[0] = 1
        seen: set[int] = set()
        for whole in batches:
            for lo in range(0, whole.num_rows, _BLOCK):
                b = whole.slice(lo, _BLOCK)
                w, n = words(b.column(1).to_pylist())
                members, size, route = sets_of(w, n, width, _routes(w, n, width, words_, hot_word))
                h = set_hash(members, size)
                # a row that is too short may have the same set as one that is not
                fit = np.flatnonzero((n >= least) & (size > 0))
                _, first = np.unique(h[fit], return_index=True)
                take = np.zeros(len(h), bool)
                take[fit[first]] = True
                take[take] = [x not in seen for x in h[take].tolist()]
                if len(seen) > 500_000:
                    seen.clear()
                seen.update(h[take].tolist())
                mine = np.repeat(take, size)
                members, route, size, h = members[mine], route[mine], size[take], h[take]
                if not len(h):
                    continue
                bits = _bits(members, size)
                great = size > WIDE
                wide, wide_at = _bits(members[np.repeat(great, size)], size[great], WIDE_WORDS), np.cumsum(great) - 1
                doc = np.repeat(np.arange(len(h)), size)
                rank = tokens.of(members)
                key = (doc.astype(_U) << _U(52)) | (rank.astype(_U) << _U(44)) | (members >> _U(64 - HASH_BITS))
                o = np.argsort(key)
                if (key[o[1:]] == key[o[:-1]]).any():
                    o = np.lexsort((members, key))
                pos = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
                long_ = (size - -(-size * t.numerator // t.denominator) + 1)[doc]
                short = (size - _least_overlap(2 * size, t) + 1)[doc]
                keep = pos < long_
                o, doc, inner = o[keep], doc[keep], (pos < short)[keep]
                members, route, rank = members[o], route[o], rank[o]
                s = blocks_of[rank]
                own = (h[doc].view(_U) % s.astype(_U)).astype(np.int64)
                # a bucket in s blocks becomes the s*(s+1)/2 pairs of its blocks; mostly s is 1
                rep = np.repeat(np.arange(len(members)), s)
                other = np.arange(len(rep)) - np.repeat(np.cumsum(s) - s, s)
                mine = own[rep]
                i, j = np.minimum(mine, other), np.maximum(mine, other)
                name = mix(members[rep] * _U(0x9E3779B97F4A7C15) + (i * 65_537 + j).astype(_U))
                side = np.where(i == j, 2, (mine == j).astype(np.int64))
                part = (np.where(s[rep] == 1, route[rep], name) >> _U(33)).astype(np.int64) % parts
                o = np.argsort(part * _BLOCK + doc[rep], kind="stable")
                rep, part, name, side = rep[o], part[o], name[o], side[o]
                d = doc[rep]
                fresh = np.r_[True, (d[1:] != d[:-1]) | (part[1:] != part[:-1])]
                low = ((name & _U((1 << 28) - 1)).astype(np.uint32) << 4) | (fresh.astype(np.uint32) << 3) | (side.astype(np.uint32) << 1) | inner[rep].astype(np.uint32)
                ids, at = d[fresh], part[fresh]
                ps = np.unique(at)
                e, x = np.searchsorted(part, np.r_[ps, parts]), np.searchsorted(at, np.r_[ps, parts])
                hs, ss, bs = h[ids], size[ids].astype(np.int32), bits[ids]
                big = ss > WIDE
                large, upto = wide[wide_at[ids[big]]], np.r_[0, np.cumsum(big)]
                blobs = [
                    b"".join(v.tobytes() for v in (np.array([z - a, k - i], np.int64), hs[a:z], bs[a:z], ss[a:z], low[i:k], large[upto[a] : upto[z]]))
                    for a, z, i, k in zip(x, x[1:], e, e[1:])
                ]
                yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    return rows.mapInArrow(pack, "part int, blob binary")


def posting(bucket: np.ndarray, side: np.ndarray, rec: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Bucket (28 bits), side (2), record (32) and inner (1) as one key; ordered by bucket, side, then record."""
    return (bucket.astype(_U) << _U(35)) | (side.astype(_U) << _U(33)) | (rec.astype(_U) << _U(1)) | inner.astype(_U)


class _Unpacker:
    """Gathers blobs into records (hash, signatures, size), once each, and postings."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = [[], [], [], [], []]

    def add(self, blob) -> None:
        n, m = (int(x) for x in np.frombuffer(blob, np.int64, 2))
        at = 16
        for to, kind, k in zip(self.parts, (np.int64, _U, np.int32, np.uint32), (n, n * SIG_WORDS, n, m)):
            to.append(np.frombuffer(blob, kind, k, at).copy())
            at += k * np.dtype(kind).itemsize
        great = int((self.parts[2][-1] > WIDE).sum())
        self.parts[4].append(np.frombuffer(blob[at:], np.uint8).view(_U).copy().reshape(great, WIDE_WORDS))

    def _take(self, i: int) -> np.ndarray:
        out = np.concatenate(self.parts[i])
        self.parts[i] = []
        return out

    def result(self, t: Fraction) -> tuple[np.ndarray, Records, np.ndarray]:
        """(hashes, records in order of size, postings ascending)."""
        uniq, first, back = np.unique(self._take(0), return_index=True, return_inverse=True)
        size, bits = self._take(2), self._take(1).reshape(-1, SIG_WORDS)
        at = (np.cumsum(size > WIDE) - 1)[first]
        size, bits = size[first], bits[first]
        o = np.lexsort((bits[:, 0], size))
        place = np.empty(len(o), np.int64)
        place[o] = np.arange(len(o))
        size, bits, at = size[o], bits[o], at[o]
        records = Records(size, bits, self._take(4)[at[size > WIDE]], t)
        low = self._take(3)
        rec = place[back][np.cumsum(low >> np.uint32(3) & np.uint32(1)) - 1]
        key = posting(low >> np.uint32(4), (low >> np.uint32(1)) & np.uint32(3), rec, low & np.uint32(1))
        del rec, low
        key.sort()
        # the same set from two tasks: its postings are there twice
        return uniq[o], records, key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key


def _search(postings: DataFrame, parts: int, t: Fraction, report: bool = False) -> DataFrame:
    """(a, b): set hashes of pairs that the signature trees let through, a < b; or, as a report, the counts of each partition."""
    names = ["records", "postings", "visited", "pruned", "compared", "kept"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, some = _Unpacker(), False
        for b in batches:
            for x in b.column(1):
                got.add(memoryview(x.as_buffer()))
                some = True
        if not some:
            return
        h, records, postings_ = got.result(t)
        del got
        pairs, forest = search_buckets(postings_, records)
        if report:
            row = (len(h), len(postings_), forest.visited, forest.pruned, forest.compared, len(pairs))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names)
            return
        i, j = np.divmod(pairs, len(h))
        for lo in range(0, len(i), 65_536):
            a, b = h[i[lo : lo + 65_536]], h[j[lo : lo + 65_536]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    blobs = postings.repartitionById(parts, "part")
    if report:
        return blobs.mapInArrow(search, ", ".join(f"{x} bigint" for x in names))
    return blobs.mapInArrow(search, "a bigint, b bigint").distinct()


def _filter_at(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(_U)) >> _U(64 - bits)).astype(np.int64)


def _row_filter(ids: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(packed bits of the row ids, their number as a power of two); a row whose bit is off is not among them.

    Every task sets the bits of a stretch of its own, so that no more than the filter is sent.
    """
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], math.ceil(math.log2(16 * max(n, 1)))))
    cuts = max(1, (1 << bits) >> 23)
    wide = (1 << bits) // cuts

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _filter_at(b.column(0).to_numpy(zero_copy_only=False), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at // wide).astype(np.int32)), pa.array((at % wide).astype(np.int32))], ["cut", "at"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on: dict[int, np.ndarray] = {}
        for b in batches:
            cut_, at = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for c in np.unique(cut_):
                on.setdefault(int(c), np.zeros(wide, bool))[at[cut_ == c]] = True
        for c, x in on.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(np.packbits(x).tobytes(), 1)], pa.binary())], ["cut", "x"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in ids.mapInArrow(place, "cut int, at int").repartitionById(cuts, "cut").mapInArrow(mark, "cut int, x binary").collect():
        out[r["cut"] * (wide // 8) : (r["cut"] + 1) * (wide // 8)] = np.frombuffer(zlib.decompress(r.x), np.uint8)
    return out, bits


def _members(rows: DataFrame, filter_: tuple[np.ndarray, int], width: int) -> DataFrame:
    """(row_id, members array<bigint>), whole shingle hashes, of the rows that the filter lets through."""
    sent = rows.sparkSession.sparkContext.broadcast(filter_)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, bits = sent.value
        for b in batches:
            at = _filter_at(b.column(0).to_numpy(zero_copy_only=False), bits)
            b = b.filter(pa.array((on[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            for lo in range(0, b.num_rows, _BLOCK):
                c = b.slice(lo, _BLOCK)
                _, members, size = text_sets(c.column(1).to_pylist(), width)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(members.view(np.int64)))
                yield pa.RecordBatch.from_arrays([c.column(0), lists], ["row_id", "members"])

    return rows.mapInArrow(read, "row_id bigint, members array<bigint>")


def _prepared(rows: DataFrame, width: int, t: Fraction, least: int, hot: int, parts: int | None) -> tuple[DataFrame, DataFrame, int]:
    """(members, postings, search partitions) of rows."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(8, math.ceil(chars / (8 * PART_CHARS)))
    kept = _profile(rows, width, least, slices)
    common = _common(kept.where("slice is not null").select("slice", "counts"), slices)
    members = kept.where("row_id is not null and n > 0").select("row_id", "n", "set_hash")
    parts = parts or max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / PART_CHARS))
    # a word that is the rarest of more shingles than a partition is meant for is hot
    hot_word = int(min(255, 1 + 8 * math.log2(max(2, chars / 8 / parts))))
    return members, _postings(rows, common, width, least, t, parts, hot, hot_word), parts


def similar_sets(rows: DataFrame, *, width: int = 5, threshold: float = 0.8, least_words: int = 0, hot_bucket: int = HOT_BUCKET, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of rows (row_id bigint unique, text string).

    members: (row_id, n, set_hash) of every row with at least least_words words
    and at least one shingle of `width` words; rows of one set_hash have the
    same set. pairs: (a, b, similarity), set hashes a < b of different sets
    whose Jaccard similarity is at least the threshold; none is lost, as
    candidates come from exact prefixes and are compared member by member.
    Shingles and sets go by hashes of 64 bits.
    """
    t = Fraction(str(threshold))
    members, postings, n = _prepared(rows, width, t, least_words, hot_bucket, parts)
    found = cut(_search(postings, n, t))
    one = members.groupBy("set_hash").agg(F.min("row_id").alias("row_id"))
    ends = found.select(F.explode(F.array("a", "b")).alias("set_hash")).distinct()
    reps = cut(ends.join(one, "set_hash"))
    n_reps = reps.count()
    sets = _members(rows, _row_filter(reps.select("row_id"), n_reps), width)
    sets = sets.join(F.broadcast(reps) if n_reps <= BROADCAST_ROWS else reps, "row_id").select("set_hash", "members")
    left, right = sets.select(F.col("set_hash").alias("a"), F.col("members").alias("ma")), sets.select(F.col("set_hash").alias("b"), F.col("members").alias("mb"))
    both = F.size(F.array_intersect("ma", "mb"))
    q = found.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("ma") + F.size("mb") - both).alias("either"))
    enough = F.col("both") * F.lit(t.denominator) >= F.col("either") * F.lit(t.numerator)
    return q.where(enough).select("a", "b", (F.col("both") / F.col("either")).alias("similarity")), members


def search_report(rows: DataFrame, *, width: int = 5, threshold: float = 0.8, least_words: int = 0, parts: int | None = None) -> DataFrame:
    """What the signature trees did, a row per search partition: records, postings, node pairs visited and
    pruned, record pairs compared by signature, and pairs kept for comparison member by member."""
    t = Fraction(str(threshold))
    _, postings, n = _prepared(rows, width, t, least_words, HOT_BUCKET, parts)
    return _search(postings, n, t, report=True)


#: Rows of a small side that may be broadcast.
BROADCAST_ROWS = 500_000
#: Copies of one set up to which every pair of them is written out.
EXPAND_COPIES = 1_000


def record_rows(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, owners) of two tables of (id bigint, ord bigint, text string).

    Records are the non-null ids of first, and those of second that first does
    not have; the text of a record is that of its row with the highest ord (a
    null ord is lowest). rows: (row_id, text) of all rows of first and of the last rows of
    second's own records. owners: (id, row_id) of each record.
    """
    spark = first.sparkSession

    def rid(table: int, ord_: str) -> Column:
        return F.xxhash64(F.lit(table), "id", ord_)

    first, second = first.where("id is not null"), second.where("id is not null")
    last1 = first.groupBy("id").agg(F.max("ord").alias("ord"))
    last2 = cut(second.groupBy("id").agg(F.max("ord").alias("ord")).join(last1.select("id"), "id", "left_anti"))
    small = last2.count() <= BROADCAST_ROWS
    own = last2.select(F.col("id").alias("oid"), F.col("ord").alias("oord"))
    rows2 = second.join(F.broadcast(own) if small else own, (F.col("id") == F.col("oid")) & F.col("ord").eqNullSafe(F.col("oord")), "left_semi")
    rows = first.select(rid(1, "ord").alias("row_id"), "text").unionByName(rows2.select(rid(2, "ord").alias("row_id"), "text"))
    owners = last1.select("id", rid(1, "ord").alias("row_id")).unionByName(last2.select("id", rid(2, "ord").alias("row_id")))
    return rows, owners


def similar_records(rows: DataFrame, owners: DataFrame, *, width: int = 5, threshold: float = 0.8, least_words: int = 0, expand: int = EXPAND_COPIES) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs of records whose shingle sets are similar enough.

    Records with the same set are pairs, too. A set with more than `expand`
    records is given by its representative, the record with the least id: it is
    paired with each copy, and with the representatives or records of similar
    sets; similar_classes at the same width and least_words has the membership and
    the copies of each class, from which all_pairs restores every pair, so nothing is lost and the result
    stays in proportion to the input however many copies there are. Records
    with null, empty or short texts have no pairs.
    """
    pairs, members = similar_sets(rows, width=width, threshold=threshold, least_words=least_words)
    rec = cut(members.join(owners, "row_id").select("id", "set_hash").distinct())
    per = rec.groupBy("set_hash").agg(F.count("*").alias("copies"), F.min("id").alias("rep"))
    multi = rec.join(per.where(F.col("copies") > 1), "set_hash")
    few = multi.where(F.col("copies") <= expand)
    a, b = few.select("set_hash", F.col("id").alias("id_a")), few.select("set_hash", F.col("id").alias("id_b"))
    same = a.join(b, "set_hash").where("id_a < id_b").select("id_a", "id_b")
    star = multi.where((F.col("copies") > expand) & (F.col("id") > F.col("rep"))).select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    speak = rec.join(per, "set_hash").where((F.col("copies") <= expand) | (F.col("id") == F.col("rep"))).select("set_hash", "id")
    other = pairs.join(speak.select(F.col("set_hash").alias("a"), F.col("id").alias("x")), "a").join(speak.select(F.col("set_hash").alias("b"), F.col("id").alias("y")), "b")
    other = other.where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return same.unionByName(star).unionByName(other)


def all_pairs(found: DataFrame, classes: DataFrame, *, expand: int = EXPAND_COPIES) -> DataFrame:
    """Every similar pair (id_a, id_b), from what similar_records and similar_classes gave at one width, threshold and expand.

    A representative of more than `expand` copies stands for all of them. The
    result grows with the square of the copies: it is meant for the ids one asks for, not for whole tables.
    """
    m = classes.where(F.col("copies") > expand).select(F.col("class_id").alias("rep"), "id")
    a, b = m.select(F.col("rep").alias("ra"), F.col("id").alias("a")), m.select(F.col("rep").alias("rb"), F.col("id").alias("b"))
    both = found.join(a, F.col("id_a") == F.col("ra"), "left").join(b, F.col("id_b") == F.col("rb"), "left")
    both = both.select(F.coalesce("a", "id_a").alias("a"), F.coalesce("b", "id_b").alias("b")).where("a <> b")
    return both.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def similar_classes(rows: DataFrame, owners: DataFrame, *, width: int = 5, threshold: float = 0.8, least_words: int = 0) -> DataFrame:
    """(id, class_id, copies, links): each record with the class of its set.

    class_id is the least id with the same set, copies the records in the class,
    links the number of similar classes with another set.
    """
    pairs, members = similar_sets(rows, width=width, threshold=threshold, least_words=least_words)
    rec = cut(members.join(owners, "row_id").select("id", "set_hash").distinct())
    per = rec.groupBy("set_hash").agg(F.count("*").alias("copies"), F.min("id").alias("class_id"))
    live = per.select("set_hash")
    ends = pairs.join(live.withColumnRenamed("set_hash", "a"), "a", "left_semi").join(live.withColumnRenamed("set_hash", "b"), "b", "left_semi")
    links = ends.select(F.explode(F.array("a", "b")).alias("set_hash")).groupBy("set_hash").agg(F.count("*").alias("links"))
    return rec.join(per, "set_hash").join(links, "set_hash", "left").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
