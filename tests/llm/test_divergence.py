import random
import re
from collections import Counter, defaultdict

import duckdb

from tallyloom.llm import divergence
from tallyloom.llm.queries import OP11_SQL, op11_source_divergence
from tests.oracle import compare

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def made_rows():
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ["éa", "zu", "Ko", "ſ", "λο"] for b in "abcdefghi"]
    rows = []
    for i in range(420):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["web", "book", "forum", ""])
        words = rng.choices(vocabulary[:: 1 + (source == "book")], k=rng.randint(0, 25)) + rng.choices(["Rare" + chr(97 + i % 26), "x1y", "É"], k=2)
        rows.append((rng.choice([i, None]), rng.choice([" ", "--", "\n", "7"]).join(words), lang, source))
    rows += [(1, None, "en", "none"), (2, "", "en", "web"), (3, "alone", "xx", None), (3, "alone", "xx", None), (4, "123", "yy", "one"), (5, None, "yy", "two"), (6, "!", "yy", "three")]
    rows += [(7, "word " * 40_000 + "Tail", "en", "long"), (8, "x" * 200_000, "en", "long")]
    return rows + rows[10:30]


def brute(rows, least=30, top=50):
    docs, count, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        docs.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    kept = defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= least:
            kept[lang].append(t)
    share = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
    p, q = {}, {}
    for lang, source in groups:
        total = sum(count[lang, source, t] for t in kept[lang])
        p[lang, source] = {t: share(count[lang, source, t], total, len(kept[lang])) for t in kept[lang]}
    for lang in {g[0] for g in groups}:
        of = {t: sum(count[lang, s, t] for la, s in groups if la == lang) for t in kept[lang]}
        q[lang] = {t: share(c, sum(of.values()), len(of)) for t, c in of.items()}
    out = []
    for lang, source in groups:
        mine = p[lang, source]
        pairs = [(s, sum(abs(mine[t] - p[lang, s][t]) for t in kept[lang])) for la, s in groups if la == lang and s != source]
        terms = [(t, mine[t] - q[lang][t]) for t in kept[lang] if count[lang, source, t] and mine[t] > q[lang][t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def test_against_brute_force_and_sql(spark, tmp_path, monkeypatch):
    rows = made_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'a' AS term", "1 AS p", "2 AS shard", "3 AS n")
    df.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    found = op11_source_divergence(spark, str(tmp_path))
    assert dict(found.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    got = sorted(map(tuple, found.collect()))
    assert got == brute(rows) and {r[2] for r in got} == {"pair", "term"}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    compare(found, con, OP11_SQL)
    # many shards, columns in many parts and merged counts passed on early give the same
    for name, value in (("SHARD_ROWS", 7), ("CELLS", 9), ("MERGE_ROWS", 20), ("TEXT_BYTES", 300)):
        monkeypatch.setattr(divergence, name, value)
    assert sorted(map(tuple, divergence.audit(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect())) == got


def test_bounds_and_empty(spark):
    rows = made_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(df, least_docs=2, top=3).collect())) == brute(rows, 2, 3)
    assert divergence.audit(df.limit(0)).count() == 0
