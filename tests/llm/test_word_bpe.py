import hashlib
import random

import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm.word_bpe import WordBpe, digests, with_decoded, with_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_padding()
LIBRARY.no_truncation()


def same(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    ours = WordBpe.load(PATH)
    assert ours.encode(text) == ids
    assert ours.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    same(text)


def test_characters_newer_than_pythons():
    rng = random.Random(8)
    new = ["\u1c89", "\u1c8a", "\ua7cb", "\ua7da", "\ua7db", "\ua7dc", *map(chr, range(0x10D40, 0x10D70)), *map(chr, range(0x105C0, 0x105F0)), *map(chr, range(0x16D40, 0x16D70)), "\u0897", "\U0001e5d0", "\U00011bf2", "\U0001cc00", "\u2ffc", "\U0002ebf5"]
    for _ in range(2000):
        same("".join(rng.choice(new + list(" aÉ1.\u0301")) for _ in range(rng.randint(1, 8))))


@pytest.mark.parametrize("text", ["", " ", "It's we'll I'D don't 'sx", "ÀÉ ñandú ΣΑΣ Σ İstanbul ǅ ß ﬁ", "é  　x\x1cy\x85z\xa0", "12345 ½ ٣", "<|endoftext|>a<|startoftext|> b<|x|>", "a" * 5000, "ab" * 3000 + "!" * 400, "日本語 中文 한국어", "😀👍🏽 ẹ́", "\x00\x01 ﻿", "x<|endoftext|"])
def test_edges(text):
    same(text)


def test_random_words():
    rng = random.Random(4)
    for _ in range(300):
        same(" ".join("".join(rng.choice("etaoinshrdlu'19.-É") for _ in range(rng.randint(1, 90))) for _ in range(5)))


def test_queries_columns(spark):
    rows = [(1, "The quick brown"), (2, None), (3, ""), (3, "The quick brown"), (None, "z" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "0 AS n_tokens")
    got = digests(df.select("doc_id", "text", "n_tokens"), PATH).collect()
    for (_, text), r in zip(rows, got, strict=True):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = with_decoded(with_ids(df, PATH), PATH).collect()
    assert back[0].decoded == LIBRARY.decode(back[0].ids, skip_special_tokens=False) and back[1].ids == []
    assert digests(df.limit(0), PATH).count() == 0
