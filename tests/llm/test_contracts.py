"""Each query's result against what its contract fixes, over whole small tables."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


def result(spark, name, docs, **types):
    df = queries.queries()[name](spark, SF)
    assert {c: t for c, t in df.dtypes if c in types} == types
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    return {r.doc_id: r for r in rows}


def remainder(doc, n):
    return zlib.crc32(str(doc).encode()) % n


@pytest.mark.parametrize(("name", "modulus", "rest", "threshold", "label"), [("op1_toxicity", 3, 1, 0.7, "toxic"), ("op4_quality_ranking", 5, 0, 0.3, "quality")])
def test_scores(spark, docs, name, modulus, rest, threshold, label):
    rows = result(spark, name, docs, doc_id="bigint", held_out="boolean", score="double", predicted="int")
    labels = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{SF}/labels.parquet'").fetchall())
    for doc, r in rows.items():
        assert r.held_out == (remainder(doc, modulus) == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    scores = collections.defaultdict(set)
    for doc, r in rows.items():
        scores[docs[doc]].add(r.score)
    assert all(len(s) == 1 for s in scores.values())  # equal texts, equal scores
    known = [(rows[d].score, y) for d, y in labels.items() if d in rows and rows[d].held_out]
    ones, zeros = [s for s, y in known if y == 1], [s for s, y in known if y == 0]
    if ones and zeros:
        assert np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]) > 0.75


def test_token_files(spark, docs):
    rows = result(spark, "op3_token_binary", docs, doc_id="bigint", start="bigint", n_tokens="bigint", ids_crc32="bigint")
    library, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for doc in sorted(docs):
        ids = [*library.encode(docs[doc], add_special_tokens=False).ids, 0]
        assert (rows[doc].start, rows[doc].n_tokens, rows[doc].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_word_codec(spark, docs):
    rows = result(spark, "op5_bpe_codec", docs, doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        r = rows[doc]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_media(spark, docs):
    rows = result(spark, "op7_webp_media", docs, doc_id="bigint", n_bytes="bigint", payload_bytes="bigint", payload_sha256="string", tail_crc32="bigint", media_bytes="bigint", media_sha256="string", feature="string")
    by_text = collections.defaultdict(set)
    for doc, text in docs.items():
        raw, r = text.encode(), rows[doc]
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        by_text[text].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())


@pytest.mark.parametrize("name", ["op2_best_fit_packing", "op6_pii_surrogates", "op8_ngram_jaccard_join", "op9_line_dedup", "op10_exact_dedup", "op12_simhash_near_dedup", "op13_fill_middle"])
def test_every_document_has_its_row(spark, docs, name):
    found = [r.doc_id for r in queries.queries()[name](spark, SF).select("doc_id").collect()]
    assert set(found) == set(docs) and (name.startswith("op2") or len(found) == len(docs))
