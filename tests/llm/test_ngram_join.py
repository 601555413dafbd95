import random
import re

import pandas as pd
import pytest

from tallyloom.llm import ngram_join


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    common = [rng.choice(words) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(n // 3)]
    texts += [" ".join([*common, *(rng.choice(words) for _ in range(rng.randint(0, 14)))]) for _ in range(n // 3)]
    while len(texts) < n:
        w = rng.choice(texts).split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize(("k", "percent", "frequent", "small"), [(4, 85, 200, 8), (3, 80, 3, 2), (2, 60, 2, 1), (1, 90, 1, 1), (1, 100, 2, 1)])
def test_components_equal_brute_force(spark, monkeypatch, k, percent, frequent, small):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "SMALL", small)
    texts = [*corpus(k), None, "", "  \n", "one", "ONE", "one two", "x" * 200_000, "A\x0bb c d E", "a b c d e"]
    rows = [(3 * i - 7, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = ngram_join.join(df, k=k, percent=percent).toPandas()
    assert sorted(found[["doc_id", "n_shingles", "component_id"]].itertuples(index=False, name=None)) == brute(rows, k, percent)


def test_large_group_of_near_copies_is_joined(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(w)))
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), k=2, percent=80).toPandas()
    assert set(found.component_id) == {0}


@pytest.mark.parametrize("percent", [60, 75, 85])
def test_differences_to_a_pivot_lose_no_pair(spark, percent):
    # one family in which many pairs are just similar or just not; every node is in one star
    rng = random.Random(percent)
    base = list(range(40))
    sets = [sorted({*rng.sample(base, 40 - rng.randint(0, 14)), *rng.sample(range(100, 130), rng.randint(0, 9))}) for _ in range(70)]
    stars = spark.createDataFrame([(0, 0, i, i, len(t), i) for i, t in enumerate(sets)], "p long, dp long, node long, d long, n long, root long")
    tokens = spark.createDataFrame([(i, i, t) for i, t in enumerate(sets)], "node long, d long, tokens array<bigint>")
    links, pairs = ngram_join._near_pivots(ngram_join._differences(stars, tokens, percent), percent)
    similar = {(i, j) for i in range(70) for j in range(i + 1, 70) if 100 * len({*sets[i]} & {*sets[j]}) >= percent * len({*sets[i]} | {*sets[j]})}
    sure = {(min(r), max(r)) for r in links.collect()}
    assert sure <= similar
    tried = {(min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect()}

    def classes(edges):
        root = list(range(70))
        for a, b in edges:
            low, high = sorted((root[a], root[b]))
            root = [low if x == high else x for x in root]
        return root

    assert classes(sure | (tried & similar)) == classes(similar)
    assert len(tried) < 70 * 69 // 2


def test_nulls_repeated_rows_and_clashing_names(spark):
    rows = [(5, "a b c d e f", 1), (5, "a b c d e f", 1), (None, "a b c d e f", 2), (None, "q r s t u v", 3), (None, None, 4), (9, None, 5), (2, "x y z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumnsRenamed({}).selectExpr("*", "1 AS sig", "2 AS node", "3 AS component_id")
    found = ngram_join.join(df).toPandas().astype(object).where(lambda x: pd.notna(x), None)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.itertuples()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 2, None), (None, 0, None), (9, 0, 9), (2, 1, 2)], key=str)


def test_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_and_candidates_follow_the_documents(spark, monkeypatch):
    """Two families of near copies that share a passage: rows of large groups and candidates per document don't grow with the families."""
    seen = []
    apart, pairs = ngram_join._apart, ngram_join._near_pivots

    def counted_apart(*args):
        few, large = apart(*args)
        seen.append(large.count())
        return few, large

    def counted_pairs(*args):
        links, more = pairs(*args)
        seen.append(more.count())
        return links, more

    monkeypatch.setattr(ngram_join, "_apart", counted_apart)
    monkeypatch.setattr(ngram_join, "_near_pivots", counted_pairs)
    per_document = []
    for n in (300, 1200):
        rng = random.Random(9)
        words = [f"w{i}" for i in range(5000)]
        passage = [rng.choice(words) for _ in range(60)]
        bases = [[rng.choice(words) for _ in range(40)] + passage for _ in range(2)]
        rows = []
        for i in range(n):
            text = list(bases[i % 2])
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((i, " ".join(text)))
        seen.clear()
        ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), k=5, percent=80).count()
        per_document.append([x / n for x in seen])
    small, large = per_document
    assert all(b <= 1.5 * a + 5 for a, b in zip(small, large)), per_document
    assert large[0] < 80


def test_joined_components_of_a_star_have_no_candidates(spark):
    """Nodes that are near the pivot make one component of all that they belong to, so its far nodes are compared with none of these; others are."""
    pivot = list(range(100))
    near = [[*pivot[2:], 200 + i % 7, 300 + i % 5] for i in range(40)]  # each a component of its own before
    far = [[*pivot[30:], *range(200, 207), *range(400, 420), 500 + i] for i in range(40)]  # linked with one of those
    other = [[*pivot[20:], *range(300, 305), *range(600, 640), 700 + i] for i in range(2)]
    for sets, roots, expect in ((near + far, [*range(40), *range(40)], False), (near + far + other, [*range(40), *range(40), 80, 81], True)):
        stars = spark.createDataFrame([(0, 0, i, i, len(t), r) for i, (t, r) in enumerate(zip([pivot, *sets], [99, *roots], strict=True))], "p long, dp long, node long, d long, n long, root long")
        tokens = spark.createDataFrame([(i, i, t) for i, t in enumerate([pivot, *sets])], "node long, d long, tokens array<bigint>")
        links, pairs = ngram_join._near_pivots(ngram_join._differences(stars, tokens, 80), 80)
        tried = {(r.a, r.b) for r in pairs.collect()}
        assert links.count() == 40 and bool(tried) == expect
        assert all({a, b} & {81, 82} for a, b in tried)


@pytest.mark.parametrize("percent", [60, 80])
def test_prefixes_of_far_nodes_are_short(spark, percent):
    """Nodes that share a passage with their pivot and little else: what only one of them has fills the prefixes, so few shared tokens need rows; similar ones still meet."""
    rng = random.Random(percent)
    passage, others = list(range(20)), list(range(1000, 1120))
    sets = [[*passage, *range(2000, 2100)]]  # the pivot
    sets += [[*passage, *rng.sample(others, 30), *range(10_000 + 100 * i, 10_060 + 100 * i)] for i in range(30)]
    sets += [[*sets[1][: len(sets[1]) - i], *range(90_000, 90_000 + i)] for i in (9, 14, 19)]
    n = len(sets)
    stars = spark.createDataFrame([(0, 0, i, i, len(t), i) for i, t in enumerate(sets)], "p long, dp long, node long, d long, n long, root long")
    tokens = spark.createDataFrame([(i, i, t) for i, t in enumerate(sets)], "node long, d long, tokens array<bigint>")
    differences = ngram_join._differences(stars, tokens, percent)
    links, pairs = ngram_join._near_pivots(differences, percent)
    similar = {(i, j) for i in range(n) for j in range(i + 1, n) if 100 * len({*sets[i]} & {*sets[j]}) >= percent * len({*sets[i]} | {*sets[j]})}
    assert similar <= {(min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect()} | {(min(r), max(r)) for r in links.collect()}
    assert similar
    rows = ngram_join._prefixes(differences, percent)[1].groupBy("node").count().collect()
    apart = (100 - percent) * 2 * 110 / (100 + percent)
    own = {i: 60 for i in range(2, 31)}  # tokens that no other node has
    assert all(r["count"] <= max(0, apart + 1 - own[r.node]) for r in rows if r.node in own), rows
