"""Token ids of a corpus by byte-level BPE, by replaying merges over the distinct words of the whole corpus.

Texts are split once, into blocks with a dictionary of their own. The distinct
words of all dictionaries are the vocabulary of the corpus; merges are replayed
over it, and the ids of a word go back to the dictionaries that have it.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import shared_path

#: Where the vocabulary of byte_bpe_50k lies; a parameter of every function here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters of text that share a dictionary.
BLOCK_CHARS = 8 << 20
#: Distinct words that are replayed together.
REPLAY_WORDS = 1 << 18

# White space as Unicode defines it (Python's own notion also takes U+001C to U+001F).
_SPACE = "".join(f"\\u{c:04x}" for c in range(0x10000) if chr(c).isspace() and not 0x1C <= c <= 0x1F)
# Letters and digits added after Unicode 16, for which this vocabulary's
# usual encoders are made; to those they are symbols, to the pattern library here they are not.
_LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_LATER_SET = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _LATER)


def word_pattern(exact: bool) -> str:
    """The word pattern that belongs to this vocabulary; exact knows which letters came later."""
    letter, digit = (rf"[\p{{{c}}}--[{_LATER_SET}]]" if exact else rf"\p{{{c}}}" for c in "LN")
    symbol = rf"[^{_SPACE}\p{{L}}\p{{N}}]" if not exact else rf"(?:[^{_SPACE}\p{{L}}\p{{N}}]|[{_LATER_SET}])"
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?{symbol}+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files of this kind.

    Printable Latin-1 bytes stand for themselves, the others for the code
    points from 256 on, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def load_merges(path: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """(id of each byte, merges in rank order as rows left id, right id, merged id)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
    return np.array([vocab[c] for c in _byte_letters()], np.int32), merges


class MergeReplay:
    """Applies the merges of a vocabulary, in rank order, to many distinct words together."""

    def __init__(self, byte_ids: np.ndarray, merges: np.ndarray):
        self.byte_ids = byte_ids
        self.rank = {(int(a), int(b)): r for r, (a, b, _) in enumerate(merges)}
        self.merged = merges[:, 2].tolist()

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word.

        All words lie one behind the other as a linked row of symbols. An
        inverted index holds, per mergeable pair (by rank), the places where it
        occurs. Ranks come off a heap in order; a merge visits only the places
        of its pair and enters the pairs that arise with the two neighbours. A
        merge can only give rise to pairs of later rank, as a symbol is made
        before the merges that use it, so one sweep is enough.
        """
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)].tolist()
        n = len(sym)
        end = np.cumsum(size)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        some = end[size > 0]
        nxt[some - 1] = -1
        prv[(end - size)[size > 0]] = -1
        nxt, prv = nxt.tolist(), prv.tolist()
        rank, merged = self.rank, self.merged
        places: dict[int, list[int]] = {}
        for i in range(n):
            j = nxt[i]
            if j >= 0 and (r := rank.get((sym[i], sym[j]))) is not None:
                places.setdefault(r, []).append(i)
        heap = list(places)
        heapq.heapify(heap)
        pairs = list(rank) if heap else []
        while heap:
            r = heapq.heappop(heap)
            a, b = pairs[r]
            new = merged[r]
            for i in places.pop(r):
                j = nxt[i]
                if j < 0 or sym[i] != a or sym[j] != b:
                    continue  # an earlier merge took one of the two
                sym[i], sym[j] = new, -1
                k = nxt[i] = nxt[j]
                if k >= 0:
                    prv[k] = i
                    if (q := rank.get((new, sym[k]))) is not None:
                        if q in places:
                            places[q].append(i)
                        else:
                            places[q] = [i]
                            heapq.heappush(heap, q)
                p = prv[i]
                if p >= 0 and (q := rank.get((sym[p], new))) is not None:
                    if q in places:
                        places[q].append(p)
                    else:
                        places[q] = [p]
                        heapq.heappush(heap, q)
        flat = np.array(sym, np.int32)
        live = flat >= 0
        kept = np.r_[0, np.cumsum(live)]
        flat = flat[live]
        return [flat[kept[e - s] : kept[e]] for s, e in zip(size, end)]


def splitter() -> Callable[[str], list[str]]:
    """The function that cuts a text into the words within which merges are made."""
    import regex

    plain, exact = (regex.compile(word_pattern(x), regex.V1).findall for x in (False, True))
    later = regex.compile(f"[{_LATER_SET}]").search
    return lambda t: plain(t) if t.isascii() or not later(t) else exact(t)


def split_block(find: Callable[[str], list[str]], texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words in order of appearance, number of each word of all texts, words of each text)."""
    code: dict[str, int] = {}
    per = np.zeros(len(texts), np.int64)
    occ: list[int] = []
    for i, t in enumerate(texts):
        if t:
            ws = find(t)
            per[i] = len(ws)
            occ += [code.setdefault(w, len(code)) for w in ws]
    return list(code), np.array(occ, np.int32), per


def spell_out(ids: np.ndarray, start: np.ndarray, code: np.ndarray, per: np.ndarray) -> pa.ListArray:
    """The ids of each text, from those of its words: word c has ids[start[c]:start[c + 1]]."""
    first, size = start[code], start[code + 1] - start[code]
    total = np.r_[0, np.cumsum(size)]
    flat = ids[np.arange(total[-1]) - np.repeat(total[:-1] - first, size)] if len(code) else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(total[np.r_[0, np.cumsum(per)]], pa.int32()), pa.array(flat, pa.int32()))


def encode_block(texts: list[str | None], find: Callable[[str], list[str]], replay: MergeReplay) -> pa.ListArray:
    """A list of ids per text, of one block by itself."""
    distinct, code, per = split_block(find, texts)
    made = replay.encode(distinct)
    ids = np.concatenate(made) if made else np.zeros(0, np.int32)
    return spell_out(ids, np.r_[0, np.cumsum([len(m) for m in made])].astype(np.int64), code, per)


_BLOCK = "block bigint, words array<string>, keys binary, per binary, codes binary"


def _split(df: DataFrame, key: str, text: str, block_chars: int) -> DataFrame:
    """Blocks of texts as numbers of words, each with its dictionary; written to the shared folder, as they are read twice."""
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find, block = splitter(), TaskContext.get().partitionId() << 32
        for b in batches:
            texts, keys = b.column(1), b.column(0)
            size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(size) // block_chars
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    distinct, code, per = split_block(find, texts.slice(lo, hi - lo).to_pylist())
                    own = keys.slice(lo, hi - lo)
                    there = own.is_valid().to_numpy(zero_copy_only=False)
                    both = np.stack([own.fill_null(0).to_numpy(zero_copy_only=False), there.astype(np.int64)])
                    cols = [pa.array([x.tobytes()], pa.binary()) for x in (both, per.astype(np.int32), code)]
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([distinct], pa.list_(pa.string())), *cols], ["block", "words", "keys", "per", "codes"])
                    block += 1

    path = shared_path(spark, "split-texts")
    df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(run, _BLOCK).write.parquet(path)
    return spark.read.schema(_BLOCK).parquet(path)


def encode_words(vocabulary: DataFrame, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """(word, ids) of distinct words (word string): the merge replay. ids are the bytes of 32-bit numbers."""
    merges = vocabulary.sparkSession.sparkContext.broadcast(load_merges(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, held, n = None, [], 0

        def made() -> pa.RecordBatch:
            ws = pa.concat_arrays(held)
            got = replay.encode(ws.to_pylist())
            return pa.RecordBatch.from_arrays([ws, pa.array([m.tobytes() for m in got], pa.binary())], ["word", "ids"])

        for b in batches:
            if not b.num_rows:
                continue
            if replay is None:
                replay = MergeReplay(*merges.value)
            held.append(b.column(0))
            n += b.num_rows
            if n >= REPLAY_WORDS:
                yield made()
                held, n = [], 0
        if n:
            yield made()

    return vocabulary.mapInArrow(run, "word string, ids binary")


def encode_texts(df: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer_path: str = TOKENIZER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key bigint, ids array<int>): the token ids of every row's text, without special tokens.

    Texts are encoded as they are; strings that look like special tokens are
    plain text. Null and empty texts get an empty list. Every row counts, also
    repeated ones and those with a null key; an empty table gives an empty
    result; other columns are not read. A text of any length is encoded whole.

    Words of a text are merged independently of each other, so a word of the
    corpus is replayed once, however often it occurs. What is shuffled are the
    dictionaries of blocks (each word once a block) and the texts as numbers of
    words, once; a word in every text is one row a block and no hot key. Only
    the tokenizer's own merges, of fixed size, are broadcast.
    """
    spark = df.sparkSession
    blocks = _split(df, key, text, block_chars)
    entries = blocks.select("block", F.posexplode("words").alias("code", "word"))
    coded = entries.join(encode_words(entries.select("word").distinct(), tokenizer_path), "word")
    none = F.lit(None).cast("binary")
    rows = coded.select("block", "code", "ids", none.alias("keys"), none.alias("per"))
    # a code of null comes after the dictionary
    rows = rows.unionByName(blocks.select("block", F.lit(None).cast("int").alias("code"), F.col("codes").alias("ids"), "keys", "per"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(n, "block").sortWithinPartitions("block", F.asc_nulls_last("code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat: list[bytes] = []
        size: list[np.ndarray] = []
        for b in batches:
            texts = np.flatnonzero(~b.column(1).is_valid().to_numpy(zero_copy_only=False))
            lo = 0
            for at in [*texts.tolist(), b.num_rows]:
                if at > lo:
                    got = b.column(2).slice(lo, at - lo)
                    flat += got.to_pylist()
                    size.append(pc.binary_length(got).to_numpy() // 4)
                if at < b.num_rows:
                    code, per = (np.frombuffer(b.column(i)[at].as_py(), np.int32) for i in (2, 4))
                    key, there = np.frombuffer(b.column(3)[at].as_py(), np.int64).reshape(2, -1)
                    keys = pa.array(key, mask=there == 0)
                    start = np.r_[0, np.cumsum(np.concatenate(size) if size else [])].astype(np.int64)
                    out = spell_out(np.frombuffer(b"".join(flat), np.int32), start, code, per)
                    for i in range(0, len(keys), 4096):
                        yield pa.RecordBatch.from_arrays([keys.slice(i, 4096), out.slice(i, 4096)], ["key", "ids"])
                    flat, size = [], []
                lo = at + 1

    return rows.mapInArrow(run, "key bigint, ids array<int>").withColumnRenamed("key", key)
