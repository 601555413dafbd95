import random
import re

import corpus_pipeline
from tallyloom.llm import queries

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, before = docs, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, SF).cache()
        assert after.columns == docs.columns
        rows = {r.doc_id: r.text for r in after.collect()}
        assert set(rows) <= set(before) and rows
        if name == "near copies":
            sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} for w in map(words, rows.values()) if w]
            assert not any(a and 100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
            assert all(rows[i] == before[i] for i in rows)
        if name == "pii":
            assert set(rows) == set(before)
            assert not any(re.search(r"\bAKIA[A-Z0-9]{16}\b", t or "") and t == before[i] for i, t in rows.items())
        at, before = after, rows
    packed = corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()
    assert {r.doc_id for r in packed} == set(before)
    assert sum(r.n_words for r in packed) == sum(len(re.findall(r"[^ \t\n\x0B\f\r]+", t or "")) for t in before.values())


def test_every_query_is_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 14))


def store(spark, folder, docs, labels):
    schema = "doc_id long, text string, lang string, source string, n_chars int, entities string, lines_deleted int, __id int, score double"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_odd_rows_and_empty_tables(spark, tmp_path):
    row = lambda i, text, lang="en", source="web": (i, text, lang, source, None if text is None else len(text), "mine", 7, 3, 0.5)
    rng = random.Random(6)
    prose = lambda n: " ".join(f"word{rng.randrange(3000)}" for _ in range(n))
    copied = prose(80)
    docs = [row(1, None), row(2, ""), row(3, "  \n "), row(4, copied), row(4, copied), row(5, copied), row(None, prose(30)), row(None, None, None, None), row(6, prose(3000)), row(7, "mail jo@example.org now " + prose(20), None), row(-8, prose(12), "xx", None)]
    store(spark, str(tmp_path / "odd"), docs, [])
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    kept = {r.doc_id for r in out}
    assert kept == {1, 2, 3, 4, None, 6, 7, -8}  # 5 is a copy of 4; nothing is rejected without labels
    assert sum(r.doc_id == 4 for r in out) == 2 and sum(r.doc_id is None for r in out) == 2 and sum(r.doc_id == 6 for r in out) == 2
    at = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path / "odd"))
        assert at.columns == ["doc_id", "text", "lang", "source", "n_chars", "entities", "lines_deleted", "__id", "score"], name
        assert {(r.entities, r.lines_deleted, r["__id"], r.score) for r in at.collect()} == {("mine", 7, 3, 0.5)}
    store(spark, str(tmp_path / "none"), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
