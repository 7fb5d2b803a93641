"""Held-out texts that occur in a training corpus, by a stored positional inverted index.

The corpus is indexed once: for every shard of documents and every word of the
held-out set, the places where the word stands. Each window of successive
held-out words is looked for from its rarest word: in the shards that have that
word, the list of its places is intersected with the lists of the other words,
shifted by their offsets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import words
from tessera.session import cut, shared_path

#: Documents of a shard.
SHARD_DOCS = 4096
#: Words of the held-out set up to which the index is kept to them; beyond, all words are indexed.
VOCABULARY = 1 << 20
#: Bytes of packed held-out passages up to which they are broadcast; beyond, they are joined by salted term.
BROADCAST_BYTES = 16 << 20
#: Parts into which the shards of a term are split where passages are joined by term.
SALTS = 16
#: Places that are looked at together.
_CHUNK = 1 << 20


# --- index -------------------------------------------------------------------


def place_words(texts: list[str | None], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash and place of each word, place of the first word of each text): texts lie behind each other, `gap` places apart."""
    h, per = words(texts)
    start = np.cumsum(per + gap) - (per + gap)
    first = np.cumsum(per) - per
    return h, np.arange(len(h)) + np.repeat(start - first, per), start


def pack_lists(places: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Lists of ascending places (list i begins at first[i]) as steps of seven bits a byte, the first step from 0."""
    step = np.diff(places, prepend=0)
    step[first] = places[first]
    size = 1 + sum((step >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28, 35, 42, 49, 56))
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        more = (size[on] > k + 1).astype(np.uint8) << 7
        out[(end - size)[on] + k] = ((step[on] >> (7 * k)) & 127).astype(np.uint8) | more
    edge = (end - size)[first].tolist() + [len(out)]
    whole = out.tobytes()
    return [whole[i:j] for i, j in zip(edge, edge[1:])]


def unpack_lists(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all places, number of places of each list)."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    b = np.frombuffer(b"".join(lists), np.uint8)
    last = b < 128
    begin = np.flatnonzero(np.r_[True, last[:-1]]) if len(b) else np.zeros(0, np.int64)
    nth = np.arange(len(b)) - np.repeat(begin, np.diff(np.r_[begin, len(b)]))
    step = np.add.reduceat((b & 127).astype(np.int64) << (7 * nth), begin) if len(b) else np.zeros(0, np.int64)
    upto = np.r_[0, np.cumsum(last)]
    edge = upto[np.r_[0, np.cumsum(size)]]
    n = np.diff(edge)
    total = np.cumsum(step)
    before = np.r_[0, total][edge[:-1]]
    return total - np.repeat(before, n), n


def store_index(docs: DataFrame, path: str, *, vocabulary: np.ndarray | None = None, gap: int = 64) -> DataFrame:
    """Write the positional index of docs (doc bigint, text string) to path and return it.

    Rows: (shard bigint, term bigint, n int, places binary): the places of a
    word in a shard, ascending (see pack_lists). The row of term null has the documents of the
    shard: their ids and first places. vocabulary: hashes of the words that are
    indexed, ascending (None: all). Null ids are kept; null and empty texts have no words.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo in range(0, b.num_rows, SHARD_DOCS):
                block = b.slice(lo, SHARD_DOCS)
                h, at, start = place_words(block.column(1).to_pylist(), gap)
                if (known := sent.value) is not None:
                    ok = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
                    h, at = h[ok], at[ok]
                if not len(h):
                    continue
                o = np.argsort(h, kind="stable")
                h, at = h[o], at[o]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                n = np.diff(np.r_[first, len(h)])
                lists = pack_lists(at, first)
                ids, there = block.column(0), block.column(0).is_valid().to_numpy(zero_copy_only=False)
                head = zlib.compress(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() + start.astype(np.int64).tobytes() + there.astype(np.int64).tobytes(), 1)
                terms = pa.array(np.r_[0, h[first].view(np.int64)], mask=np.r_[True, np.zeros(len(first), bool)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n) + 1, shard)), terms, pa.array(np.r_[0, n], pa.int32()), pa.array([head, *lists], pa.binary())], ["shard", "term", "n", "places"]
                )
                shard += 1

    docs.select(F.col("doc").cast("bigint").alias("doc"), "text").mapInArrow(index, "shard bigint, term bigint, n int, places binary").write.mode("overwrite").parquet(path)
    return spark.read.schema("shard bigint, term bigint, n int, places binary").parquet(path)


class Shard:
    """The lists of one shard: documents, and the places of each term."""

    def __init__(self, head: bytes, terms: np.ndarray, lists: list[bytes]):
        doc, self.start, there = np.frombuffer(zlib.decompress(head), np.int64).reshape(3, -1)
        self.ids = pa.array(doc, mask=there == 0)
        o = np.argsort(terms)
        self.terms = terms[o]
        self.places, n = unpack_lists([lists[i] for i in o])
        self.first = np.r_[0, np.cumsum(n)].astype(np.int64)
        # all lists behind each other, as one ascending list of (term, place)
        self.width = int(self.places.max(initial=0)) + 1
        self.key = np.repeat(np.arange(len(n)), n) * self.width + self.places

    def codes(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term's list in this shard, -1 for none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def near(self, code: np.ndarray, want: np.ndarray, slop: int) -> np.ndarray:
        """Whether the list of each code holds a place at most slop from the one wanted."""
        lo, hi = np.maximum(want - slop, 0), np.minimum(want + slop, self.width - 1)
        at = np.searchsorted(self.key, code * self.width + lo)
        return (code >= 0) & (lo <= hi) & (at < len(self.key)) & (self.key[np.minimum(at, len(self.key) - 1)] <= code * self.width + hi)


def match_passages(shard: Shard, passages: list[tuple[np.ndarray, int]], width: int, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document of the shard, passage) with `width` successive words of the passage, its anchor among them.

    A passage is (terms, anchor): its rarest word stands at the place anchor.
    The anchor's list is intersected with those of its neighbours, shifted, ever
    further out on both sides; a place goes on on a side as long as the words
    there match, and is dropped once it cannot reach width words any more.
    """
    found = []
    size = np.array([len(t) for t, _ in passages])
    anchor = np.array([a for _, a in passages])
    base = np.cumsum(size) - size
    code = shard.codes(np.concatenate([t for t, _ in passages])) if passages else np.zeros(0, np.int64)
    rare = code[base + anchor]
    n = np.where(rare >= 0, shard.first[np.maximum(rare, 0) + 1] - shard.first[np.maximum(rare, 0)], 0)
    upto, lo = np.cumsum(n), 0
    while lo < len(passages):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _CHUNK)))
        p = np.repeat(np.arange(lo, hi), n[lo:hi])
        nth = np.arange(len(p)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])
        place = shard.places[shard.first[rare[p]] + nth]
        left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        alive_l, alive_r = np.ones(len(p), bool), np.ones(len(p), bool)
        for k in range(1, width):
            for run, alive, sign in ((right, alive_r, 1), (left, alive_l, -1)):
                at = anchor[p] + sign * k
                alive &= (at >= 0) & (at < size[p])
                on = np.flatnonzero(alive)
                ok = shard.near(code[base[p[on]] + at[on]], place[on] + sign * k, slop)
                alive[on] = ok
                run[on] += ok
            # what is still open on a side could add all the words up to width
            most = left + right + 1 + np.where(alive_l, width - 1 - k, 0) + np.where(alive_r, width - 1 - k, 0)
            keep = most >= width
            p, place, left, right, alive_l, alive_r = (v[keep] for v in (p, place, left, right, alive_l, alive_r))
            if not len(p):
                break
        ok = left + right + 1 >= width
        if ok.any():
            doc = np.searchsorted(shard.start, place[ok], side="right") - 1
            found.append(np.unique(np.stack([doc, p[ok]]), axis=1))
        lo = hi
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


# --- held-out passages ---------------------------------------------------------


def split_passages(terms: np.ndarray, total: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(start, end, anchor): stretches of one text whose windows of `width` words have the same rarest word.

    total: how often each word occurs in the corpus; windows with a word that does not occur are left out.
    """
    if len(terms) < width:
        return []
    windows = np.lib.stride_tricks.sliding_window_view(total, width)
    rare = windows.argmin(axis=1) + np.arange(len(windows))
    live = windows.min(axis=1) > 0
    cut_at = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (live[1:] != live[:-1])])
    return [(int(a), int(z) + width - 1, int(rare[a])) for a, z in zip(cut_at, np.r_[cut_at[1:], len(rare)]) if live[a]]


def _item_words(held: DataFrame) -> DataFrame:
    """(item, text_id, place, term): the words of each held-out text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, SHARD_DOCS):
                c = b.slice(lo, SHARD_DOCS)
                h, per = words(c.column(2).to_pylist())
                row = pa.array(np.repeat(np.arange(len(per)), per))
                place = np.arange(len(h)) - np.repeat(np.cumsum(per) - per, per)
                yield pa.RecordBatch.from_arrays([c.column(0).take(row), c.column(1).take(row), pa.array(place, pa.int32()), pa.array(h.view(np.int64))], ["item", "text_id", "place", "term"])

    return held.mapInArrow(read, "item bigint, text_id bigint, place int, term bigint")


def _passages(item_words: DataFrame, totals: DataFrame, width: int) -> DataFrame:
    """(term, item, terms binary, anchor): passages by their rarest word."""
    known = item_words.join(totals, "term", "left")
    texts = known.groupBy("item", "text_id").agg(F.array_sort(F.collect_list(F.struct("place", "term", F.coalesce("total", F.lit(0)).alias("total")))).alias("w"))
    slim = texts.select("item", F.transform("w", lambda x: x["term"]).alias("t"), F.transform("w", lambda x: x["total"]).alias("n"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, t, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                terms, total = t.values.to_numpy(zero_copy_only=False), n.values.to_numpy(zero_copy_only=False)
                rows += [(int(terms[x]), item, terms[a:z].tobytes(), x - a) for a, z, x in split_passages(terms, total, width)]
            if rows:
                t, i, w, x = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(i, pa.int64()), pa.array(w, pa.binary()), pa.array(x, pa.int32())], ["term", "item", "terms", "anchor"])

    return slim.mapInArrow(split, "term bigint, item bigint, terms binary, anchor int").distinct()


def leaked_items(docs: DataFrame, items: DataFrame, *, width: int = 12, slop: int = 0, doc: str = "doc_id", item: str = "item_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, vocabulary: int = VOCABULARY) -> DataFrame:
    """(doc bigint, item bigint): each document with each held-out item it shares a passage with.

    A passage is `width` successive words in common, words being runs of letters
    and digits after NFKC and lower case. With slop > 0, each word may stand up
    to slop words from its place beside the rarest word of the passage (a
    proximity match). Whole texts are searched, and no passage reaches over two
    documents. Null, empty and short texts match nothing; repeated rows and ids
    give each pair once; rows with a null id are reported under null; empty
    tables give an empty result; other columns are not read.

    The positional index of the corpus, kept to words of the held-out set, is
    written to the shared folder once. Held-out windows are put together by
    their rarest word, joined by that word with the shards that have it, and go
    to those shards, where lists are intersected. Nothing of the held-out set passes
    through the driver but its distinct words, up to a bound; a word in every
    document is the rarest of a window only where all are.
    """
    spark = docs.sparkSession
    held = items.select(F.col(item).cast("bigint").alias("item"), F.xxhash64(text).alias("text_id"), F.col(text).alias("text")).where("text is not null").distinct()
    item_words = _item_words(held)
    terms = item_words.select("term").distinct().limit(vocabulary + 1).toArrow().column(0).to_numpy()
    known = np.sort(terms.view(np.uint64)) if len(terms) <= vocabulary else None
    index = store_index(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")), shared_path(spark, "leak-index"), vocabulary=known, gap=width + slop + 1)
    totals = index.where("term is not null").groupBy("term").agg(F.sum("n").alias("total"))
    passages = cut(_passages(item_words, totals, width))
    there = index.where("term is not null").select("term", "shard")
    size = passages.agg(F.sum(F.length("terms") + 24)).first()[0] or 0
    if size <= broadcast_bytes:
        wanted = there.join(F.broadcast(passages), "term")
    else:
        salt = F.pmod("shard", F.lit(SALTS)).cast("int")
        wanted = there.withColumn("salt", salt).join(passages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["term", "salt"])
    # rows of a shard: its lists (its documents first), then the passages that are looked for in it
    lists = index.select("shard", F.lit(0).alias("kind"), "term", F.lit(None).cast("bigint").alias("item"), F.col("places").alias("data"), F.lit(0).alias("anchor"))
    rows = lists.unionByName(wanted.select("shard", F.lit(1).alias("kind"), "term", "item", F.col("terms").alias("data"), "anchor"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(n, "shard").sortWithinPartitions("shard", "kind", F.asc_nulls_first("term"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, terms_, lists_, shard = None, None, [], [], None

        def hits(ids: pa.Array, data: pa.Array, anchor: pa.Array) -> Iterator[pa.RecordBatch]:
            got = [(np.frombuffer(x, np.int64), a) for x, a in zip(data.to_pylist(), anchor.to_pylist())]
            d, p = match_passages(shard, got, width, slop)
            if len(d):
                yield pa.RecordBatch.from_arrays([shard.ids.take(pa.array(d)), ids.take(pa.array(p))], ["doc", "item"])

        for b in batches:
            s, kind = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            edge = np.r_[0, np.flatnonzero((s[1:] != s[:-1]) | (kind[1:] != kind[:-1])) + 1, len(s)]
            for lo, hi in zip(edge, edge[1:]):
                if lo == hi:
                    continue
                c = b.slice(lo, hi - lo)
                if s[lo] != now:
                    now, head, terms_, lists_, shard = s[lo], None, [], [], None
                if kind[lo] == 0:
                    t, data = c.column(2).to_pylist(), c.column(4).to_pylist()
                    if head is None:
                        head, t, data = data[0], t[1:], data[1:]
                    terms_ += t
                    lists_ += data
                    continue
                if shard is None:
                    shard = Shard(head, np.array(terms_, np.int64), lists_)
                    terms_, lists_ = [], []
                yield from hits(c.column(3), c.column(4), c.column(5))

    found = rows.mapInArrow(search, "doc bigint, item bigint").distinct()
    return found.select(F.col("doc").alias(doc), F.col("item").alias(item))
