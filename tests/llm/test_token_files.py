import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 50)), max_size=700))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    index, payload = token_files.pack(ids)
    assert (token_files.unpack(index, payload)[: len(ids)] == ids).all()


def test_one_document_of_a_segment():
    rng = np.random.default_rng(2)
    n = np.array([1, 500, 0, 127, 129, 4000])
    ids = rng.integers(0, 50_000, n.sum()).astype(np.uint32)
    data = token_files.segment(np.arange(6), np.zeros(6, bool), n, ids)
    at = 0
    for i, k in enumerate(n):
        assert (token_files.document(data, i) == ids[at : at + k]).all()
        at += k


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\x00a'sé\x1c\xa0"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_pieces_encode_like_the_library(texts):
    ids, n = token_files.PieceEncoder.load(PATH).encode(pa.array(texts, pa.string()))
    expected = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(expected, []) and n.tolist() == [len(x) for x in expected]


def random_text(rng):
    space, word = ["\n", "\n\n", "\t", "\xa0", " ", "  ", "\r\n", "\u2003", "\x1c", "\x85"], ["a", "b", "the", "d'", "'s", "É", "12", "<|endoftext|>", "x" * 60, "…", "\x00", "日本"]
    begin = rng.choice([*space, "", ""])
    return begin + "".join(rng.choice(word) + rng.choice([" ", " ", " ", *space, ""]) for _ in range(rng.randint(0, 8)))


def test_many_texts_in_a_call_of_a_fresh_encoder():
    """Texts that begin with or consist of white space stand between others in one batch, and nothing is stored before."""
    rng = random.Random(8)
    for _ in range(40):
        texts = [random_text(rng) for _ in range(500)]
        encoder = token_files.PieceEncoder(PATH)
        for part in (texts[:300], texts[300:]):
            ids, n = encoder.encode(pa.array(part, pa.string()))
            expected = [x.ids for x in LIBRARY.encode_batch_fast(part, add_special_tokens=False)]
            assert n.tolist() == [len(x) for x in expected]
            assert ids.tolist() == sum(expected, [])


def test_pieces_of_nothing_but_line_feeds():
    texts = ["a\n b", "\n", "b c", "\nd", "", " ", "\n\n", "e"]
    ids, n = token_files.PieceEncoder(PATH).encode(pa.array(texts, pa.string()))
    assert ids.tolist() == sum((LIBRARY.encode(t, add_special_tokens=False).ids for t in texts), [])


def test_files_read_back(spark):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdeé .\n") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    rows = [(i * 7 % 120, t) for i, t in enumerate(texts)] + [(None, "null id"), (500, None), (501, ""), (502, "x" * 100_000), (502, "x" * 100_000), (503, "a <|endoftext|>b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS start", "2 AS data")
    found = sorted(token_files.read(token_files.write(df, PATH)).collect(), key=lambda r: r.start)
    by_id = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for (doc, text), r in zip(by_id, found, strict=True):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read(token_files.write(df.limit(0), PATH)).count() == 0
