import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import fill_middle
from tallyloom.llm.queries import OP13_SQL, op13_fill_middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def expected(doc, text, seed="1"):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abZ \n<>é€𝔘"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=60), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 1 << 30))
def test_descent_finds_every_cut(texts, block, seed):
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    trees = fill_middle.BlockTrees(np.frombuffer(b"".join(raw), np.uint8), offs, block)
    units = [UNIT.findall(t) for t in texts]
    assert trees.totals().tolist() == [len(u) for u in units]
    rng = random.Random(seed)
    which = np.array([rng.randrange(len(texts)) for _ in range(8)])
    after = np.array([rng.randint(0, len(units[i])) for i in which])
    byte, points = trees.cuts(which, after)
    heads = ["".join(units[i][:c]) for i, c in zip(which, after)]
    assert byte.tolist() == [len(h.encode()) for h in heads] and points.tolist() == [len(h) for h in heads]


ROWS = [(1, None), (2, ""), (None, "null id, with words"), (3, "a <P> b"), (4, "x" * 300_000), (5, "é€ \n" * 60_000), (6, "<"), (7, "tie"), (7, "tie"), (7, "other text of 7"), (-8, "negative id")]


def made_rows():
    rng = random.Random(3)
    return ROWS + [(100 + i, "".join(rng.choice("ab Cd.é<S\n") for _ in range(rng.randint(0, 2000)))) for i in range(200)]


def test_against_brute_force(spark):
    rows = made_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS form", "2 AS __text", "3 AS __h1").repartition(3)
    found = fill_middle.transform(df).withColumn("back", fill_middle.restored())
    assert found.columns == ["doc_id", "text", "__text", "__h1", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found.collect()), key=str)
    assert got == sorted(((d, t, *expected(d, t)) for d, t in rows), key=str)
    assert found.where("NOT back <=> coalesce(text, '')").count() == 0
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(df.limit(0)).count() == 0


def test_parameters_and_names(spark):
    df = spark.createDataFrame([(i, "some words here") for i in range(50)], "k long, body string")
    all_spm = fill_middle.transform(df, "body", "k", seed="other", percent=100, spm_percent=100)
    assert {r.form for r in all_spm.collect()} == {"spm"}
    assert {r.form for r in fill_middle.transform(df, "body", "k", percent=0).collect()} == {"plain"}
    with pytest.raises(ValueError):
        fill_middle.transform(df.withColumnRenamed("body", "output"), "output", "k")


def test_query_against_its_sql(spark, tmp_path):
    import duckdb

    from tests.oracle import compare

    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(made_rows(), "doc_id long, text string").repartition(3).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    found = op13_fill_middle(spark, str(tmp_path))
    assert dict(found.dtypes) == {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"}
    compare(found, con, OP13_SQL)
