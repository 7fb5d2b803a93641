import os
import sys

import numpy as np
import pytest

from tessera.llm.encode import TOKENIZER, MergeReplay, encode_block, encode_texts, encode_words, load_merges, splitter

tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    find, replay = splitter(), MergeReplay(*load_merges(TOKENIZER))
    return lambda texts: encode_block(texts, find, replay)


def test_every_code_point_in_context(library, encoder):
    chars = [chr(c) for c in range(0, sys.maxunicode + 1, 7) if not 0xD800 <= c <= 0xDFFF]
    chars += [chr(c) for c in range(0x3100) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"ab{c}1 {c}x  {c}\n{c}'s" for c in chars]
    assert encoder(texts).to_pylist() == library(texts)


def test_odd_texts(library, encoder):
    texts = ["", " ", "\n\n  \t a", "<|endoftext|>", "x<|endoftext|> y", "a" * 20_000, "ab" * 9_000, "\0\x1c\x1d", "don't WE'LL I'm", "é" * 500, "1234567890" * 99, "🤖🤖 naïve 漢字"]
    assert encoder(texts).to_pylist() == library(texts)


def test_every_word_of_the_corpus_is_replayed_once(spark, library):
    words = ["hello", " world", "…", "   ", "1234567"] + [f" w{i}" for i in range(3000)]
    got = encode_words(spark.createDataFrame([(w,) for w in words], "word string").repartition(3)).collect()
    assert {r.word: np.frombuffer(r.ids, np.int32).tolist() for r in got} == dict(zip(words, library(words)))


def test_blocks_of_any_size_give_the_same(spark, library):
    texts = [f"text {i} of some words, {'again ' * (i % 5)}and {i * i}" if i % 7 else None for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want = dict(enumerate(library([t or "" for t in texts])))
    for chars in (1, 500, 1 << 20):
        rows = encode_texts(df, block_chars=chars).collect()
        assert len(rows) == 400 and {r.doc_id: r.ids for r in rows} == want


def test_whole_tables(spark, library):
    rows = [(1, "hello world", "k"), (2, None, ""), (3, "", ""), (None, "x", ""), (4, "hello world", ""), (5, "long " * 30_000, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_texts(df).collect()}
    assert got == {i: library([t or ""])[0] for i, t, _ in rows}
    assert encode_texts(df.where("false")).collect() == []


def test_ids_spell_the_text(encoder):
    from tessera.llm.encode import _byte_letters
    import json

    vocab = {i: t for t, i in json.load(open(TOKENIZER, encoding="utf-8"))["model"]["vocab"].items()}
    back = {c: b for b, c in enumerate(_byte_letters())}
    text = "Round trip — ünïcödé 🤖\n\tof any text."
    ids = encoder([text]).to_pylist()[0]
    assert bytes(back[c] for i in ids for c in vocab[i]).decode() == text
