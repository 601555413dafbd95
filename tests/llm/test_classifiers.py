import random

import numpy as np
import pytest

from tallyloom.llm import quality, textvec, toxicity

WORDS = [f"{a}{b}{c}" for a in "bdfg" for b in "aeio" for c in ("n", "rt", "sh", "lla")]


def corpus(n, seed=0):
    """Documents and labels: a third are junk, a fifth insult with one of two invented stems."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randint(20, 120))]
        bad, toxic = i % 3 == 0, i % 5 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["zorkel", "mugwam"]) + rng.choice(["a", "en", "ix", "ou"])
        text = " ".join(x + rng.choice(["###", "$$$"]) if bad and rng.random() < 0.6 else x for x in w).capitalize() + "."
        docs.append((i, text))
        if i % 2 == 0:
            labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def data(spark):
    docs, labels = corpus(900)
    more = [(5000, ""), (5001, None), (None, "no id"), (5002, "idiot"), (5003, "wort " * 60_000)]
    return spark.createDataFrame([*docs, *more], "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int"), docs


def test_quality_on_held_out_rows(data):
    df, labels, docs = data
    clash = df.selectExpr("*", "'x' AS score", "7 AS predicted", "1 AS __y")
    model = quality.fit(clash, labels)
    found = {r.doc_id: r for r in quality.with_score(clash, model).collect()}
    assert len(found) == len(docs) + 5
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    right = [found[i].predicted == int(i % 3 != 0) for i, _ in docs]
    assert sum(right) / len(right) > 0.97
    assert found[5000].score == found[5001].score
    kept = quality.keep_good(clash, labels)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.predicted}


def test_toxicity_learns_stems(data):
    df, labels, docs = data
    model = toxicity.fit(df.selectExpr("*", "'x' AS score", "3 AS __votes"), labels)
    found = {r.doc_id: r for r in toxicity.with_score(df, model).collect()}
    right = [found[i].predicted == int(i % 5 == 0) for i, _ in docs]
    assert sum(right) / len(right) > 0.98
    assert found[5002].score > found[5000].score == found[5001].score


def test_without_labels_or_documents(spark, data):
    df, labels, _ = data
    none = labels.limit(0)
    assert {r.score for r in quality.with_score(df, quality.fit(df, none)).collect()} == {0.5}
    found = {r.doc_id: r.score for r in toxicity.with_score(df, toxicity.fit(df, none)).collect()}
    assert found[5002] > found[5000]
    empty = df.limit(0)
    assert quality.with_score(empty, quality.fit(empty, labels)).count() == 0
    assert toxicity.with_score(empty, toxicity.fit(empty, labels)).count() == 0


def test_labels_of_held_out_rows_teach_nothing(spark, data):
    df, labels, _ = data
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert quality.fit(df, flipped) == quality.fit(df, labels)
    a, b = toxicity.fit(df, flipped), toxicity.fit(df, labels)
    assert (a.weights == b.weights).all() and (a.lexicon.hashes == b.lexicon.hashes).all()


def test_label_model_finds_accuracies_and_discounts_copies():
    rng = np.random.default_rng(0)
    n, v = 20_000, len(toxicity.VOTERS)
    y = rng.random(n) < 0.2
    hit = np.where(y[:, None], rng.random((n, v)) < 0.7, rng.random((n, v)) < 0.05)
    masks = (hit << np.arange(v)).sum(axis=1)
    kinds, counts = np.unique(masks, return_counts=True)
    post = toxicity.label_model(kinds, counts, masks[:300], y[:300].astype(int))
    of = dict(zip(kinds.tolist(), post.tolist(), strict=True))
    assert np.mean([(of[m] > 0.5) == t for m, t in zip(masks.tolist(), y.tolist(), strict=True)]) > 0.98


def test_words_are_cut_and_hashed_alike_in_any_batch():
    texts = ["Été DÉJÀ vu", "", "a b", "x", "déjà"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    low = textvec.lower_latin(raw)
    assert bytes(low).decode() == "".join(texts).lower()
    s, e, d = textvec.spans(low, offs, textvec.LETTERS)
    assert d.tolist() == [0, 0, 0, 2, 2, 3, 4]
    h = textvec.hash_spans(low, s, e)
    assert h[1] == h[6] and len(set(h.tolist())) == 6
    alone = np.frombuffer("déjà".encode(), np.uint8)
    assert textvec.hash_spans(alone, np.array([0]), np.array([len(alone)]))[0] == h[1]


def test_copies_and_many_words_hide_no_toxic_word(spark):
    harmless = [f"{a}{b}lo{c}{d}mera" for a in "bdfgk" for b in "aeiou" for c in "bdfg" for d in "aeiou"] + [f"{a}{b}{c}{d}tolumis" for a in "mnprs" for b in "aeiou" for c in "bdfg" for d in "aeiou"]
    toxic = [f"q{a}{b}{c}" for a in "aeiou" for b in "bcdfghk" for c in "aeioubcdf"]
    copies = [(" ".join(harmless) + " " + x, 1) for x in "abcdefgh" for _ in range(5)]
    marked = [(f"one {w} {x} of two", 1) for w in toxic for x in "xyz"]
    clean = [(f"one {x} {y} of two", 0) for x in "abcdefghxyz" for y in "abcdefghijklmnopqrstuvwxyz"]
    known = spark.createDataFrame([*copies, *marked, *clean], "__text string, __y int")
    mined = toxicity._mine(known.distinct())
    assert set(toxicity._hash_words([w]).tolist()[0] for w in toxic) <= set(mined.tolist())


def test_training_weighs_patterns_by_count():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 3, 40)
    offs, counts, soft = np.concatenate([[0], np.cumsum(sizes)]), rng.integers(1, 9, 40), rng.random(40)
    hits = np.concatenate([np.sort(rng.choice(5, n, replace=False)) for n in sizes]).astype(np.int64)
    each = np.repeat(np.arange(40), counts)
    rows = [hits[offs[i] : offs[i + 1]] for i in each]
    again = toxicity.train(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows), 5, soft[each], np.ones(len(each), np.int64))
    assert np.allclose(toxicity.train(offs, hits, 5, soft, counts), again, atol=1e-6)


def test_cover_takes_every_row_twice():
    rows = [[0, 1, 3], [0, 1, 3], [0, 1, 3], [2], [2], [2], [4], [4]]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    assert toxicity.cover(offs, np.concatenate(rows), 5) == [0, 1, 2]
