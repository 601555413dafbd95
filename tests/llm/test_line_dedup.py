import random

import pytest

from tallyloom.llm import line_dedup


def brute(rows, min_words):
    """Deletes every line of every run of min_words words that also starts earlier."""
    order = sorted({(i or 0, t) for i, t in rows if t is not None})
    docs = [[(j, x) for j, x in enumerate(t.split("\n")) if any(x.split(" "))] for _, t in order]
    words = lambda x: sum(1 for w in x.split(" ") if w)
    seen, gone = {}, [set() for _ in docs]
    for d, lines in enumerate(docs):
        for i in range(len(lines)):
            total = 0
            for j in range(i, len(lines)):
                total += words(lines[j][1])
                if total >= min_words:
                    run = tuple(x for _, x in lines[i : j + 1])
                    if seen.setdefault(run, (d, i)) != (d, i):
                        gone[d].update(at for at, _ in lines[i : j + 1])
    return {(i, t): "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[d]) for d, (i, t) in enumerate(order)}


@pytest.mark.parametrize(("seed", "min_words"), [(1, 6), (2, 11), (3, 1)])
def test_equals_brute_force(spark, seed, min_words):
    rng = random.Random(seed)
    vocabulary = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5))) for _ in range(12)] + ["", " ", "é  x"]
    rows = [(i, "\n".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    passage = [f"p{i} q r" for i in range(40)]
    rows += [(100 + i, "\n".join([f"own {i}", *passage[i : 30 + i], "end"])) for i in range(8)]
    rows += [(200, "same line here\n" * 9), (201, ""), (202, "\n\n"), (203, "x " * 5000)]
    expected = brute(rows, min_words)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = line_dedup.dedup(df, min_words=min_words).collect()
    assert len(found) == len(rows)
    for r, (i, t) in ((next(r for r in found if r.doc_id == i), (i, t)) for i, t in rows):
        assert r.text == expected[i, t]


def test_nulls_repeated_rows_and_clashing_names(spark):
    long = "\n".join(f"line {i} of a passage that is long" for i in range(9))
    rows = [(1, long, 5), (1, long, 6), (None, long, 7), (None, None, 8), (2, None, 9), (3, "head\n" + long + "\ntail", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lines_deleted int").selectExpr("*", "1 AS pos", "'s' AS stretch", "2 AS gone0", "3 AS at")
    found = line_dedup.dedup(df).collect()
    assert found[0].asDict().keys() == {"doc_id", "text", "pos", "stretch", "gone0", "at", "lines_deleted"}
    # the row without an id counts as 0 and so comes first
    got = sorted((str(r.doc_id), str(r.text), r.lines_deleted) for r in found)
    assert got == sorted([("1", "", 9), ("1", "", 9), ("None", long, 0), ("None", "None", 0), ("2", "None", 0), ("3", "head\ntail", 9)])
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame([(1, "a b c\nd e f"), (2, "a b c\nd e f")], "doc_id long, text string")
    plan = line_dedup.dedup(df, min_words=2)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
