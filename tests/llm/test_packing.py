import random
from collections import Counter, defaultdict

import numpy as np

from tallyloom.llm import packing


def check(rows, found, capacity, per_source):
    bins = defaultdict(list)
    source = {r[0]: r[2] for r in rows}
    for r in found:
        bins[r.shard, r.bin].append(r)
    for inside in bins.values():
        inside.sort(key=lambda r: r.position)
        assert [r.position for r in inside] == list(range(len(inside)))
        at = 0
        for r in inside:
            assert r.bin_start == at
            at += r.n_words
        assert at <= capacity
        assert max(Counter(source[r.doc_id] for r in inside).values()) <= per_source
        assert all(n == 1 for c, n in Counter(r.cluster for r in inside).items() if c is not None)
        assert all((r.cluster is None) == (r.n_words == 0) for r in inside)
    words = defaultdict(int)
    for r in found:
        words[r.doc_id] += r.n_words
    assert dict(words) == {i: len((t or "").split()) for i, t, _ in rows}
    return bins


def test_constraints_and_words(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 90))) + f" d{rng.randint(0, 150)}", f"s{min(rng.randint(0, 9), 6)}") for i in range(500)]
    rows += [(500, None, None), (501, "", "s1"), (502, " \n", None), (503, "z " * 1000, "s2"), (504, "Z\n" * 1000, "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS bin", "2 AS __piece0", "3 AS words")
    found = packing.pack(df, capacity=64, per_source=2, shard_words=5000).collect()
    assert len({r.shard for r in found}) > 1
    check(rows, found, 64, 2)


def test_each_piece_takes_the_tightest_compatible_bin():
    rng = random.Random(3)
    ours, bins = packing.Bins(100, 2), []
    for _ in range(800):
        size, source, cluster = rng.randint(1, 60), 1 << rng.randint(0, 3), rng.choice([0, 0, 1, 2, 4])
        b, _, start = ours.place(size, source, cluster)
        # several bins may have the tightest room; the room taken must be the same as by trying them all
        before = 100 - start
        tight = [x["room"] for x in bins if x["room"] >= size and x["sources"][source] < 2 and not (cluster and cluster in x["clusters"]) and x["room"]]
        assert before == (min(tight) if tight else 100)
        # follow ours in the plain model
        if b == len(bins):
            bins.append({"room": 100, "sources": Counter(), "clusters": set()})
        x = bins[b]
        assert x["room"] == before
        x["room"] -= size
        x["sources"][source] += 1
        x["clusters"].add(cluster)


def test_one_source_and_many_copies_fill_bins_in_linear_time():
    import time

    import numpy as np

    rng = np.random.default_rng(5)
    took = []
    for n in (10_000, 40_000):
        words, cluster = rng.integers(20, 300, n // 2).repeat(2), np.arange(n // 2).repeat(2)
        began = time.process_time()
        bins, _, _ = packing.pack_shard(words, np.zeros(n, np.int64), cluster, np.arange(n), np.zeros(n, np.int64), 2048, 4)
        took.append(time.process_time() - began)
        assert bins.max() + 1 <= 1.05 * words.sum() / 2048 + 2
        assert len(set(zip(bins.tolist(), cluster.tolist(), strict=True))) == n
    assert took[1] < 12 * took[0]


def test_order_of_rows_makes_no_difference_and_empty_texts_share_bins():
    import numpy as np

    rng = np.random.default_rng(6)
    words, source, cluster, key = rng.integers(0, 40, 600), rng.integers(0, 5, 600), rng.integers(0, 90, 600), rng.integers(0, 30, 600)
    piece = np.zeros(600, np.int64)
    rows = list(zip(words, source, cluster, key, strict=True))
    found = []
    for at in (np.arange(600), rng.permutation(600)):
        made = packing.pack_shard(words[at], source[at], cluster[at], key[at], piece[at], 100, 2)
        found.append(sorted((rows[i], *map(int, x)) for i, x in zip(at, zip(*made, strict=True), strict=True)))
    assert found[0] == found[1]
    empty = packing.pack_shard(np.zeros(4000, np.int64), np.zeros(4000, np.int64), np.ones(4000, np.int64), np.arange(4000), np.zeros(4000, np.int64), 2048, 4)
    assert empty[0].max() == 0


def test_a_given_cluster(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 7), (2, "d e f", "t", 7), (3, "g h i", "u", 8), (4, "j k", "v", None)], "doc_id long, text string, source string, component_id long")
    found = {r.doc_id: r.bin for r in packing.pack(df, cluster_col="component_id").collect()}
    assert found[1] != found[2] and len(set(found.values())) == 2


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert packing.pack(empty).count() == 0
    twice = spark.createDataFrame([(None, "a b", "s")] * 2, "doc_id long, text string, source string")
    found = packing.pack(twice).collect()
    assert len(found) == 2 and len({r.bin for r in found}) == 2


def test_repeated_and_blank_rows_are_dealt_out(spark):
    rows = [(None, "one two three four", "a")] * 2000 + [(i, " ", "a") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = packing.pack(df, shard_words=2000).collect()
    assert len(found) == 4000
    for nameless in (True, False):
        held = [r.shard for r in found if (r.doc_id is None) == nameless]
        assert len(held) == 2000 and max(held.count(s) for s in set(held)) < 400
    assert len({r.shard for r in packing.pack(df.where("doc_id IS NOT NULL"), shard_words=2000).collect()}) > 8
    bins = [(r.shard, r.bin, r.cluster) for r in found if r.n_words]
    assert len(set(bins)) == len(bins) == 2000


def test_one_cluster_of_many_sizes_takes_time_in_proportion():
    """A third of the pieces in one cluster with sizes of all kinds; the result is best-fit and without conflicts, as without the hot path."""
    import time

    took = {}
    for n in (5_000, 20_000):
        rng = np.random.default_rng(n)
        words = rng.integers(1, 2049, n)
        cluster = np.where(rng.random(n) < 0.34, 7, np.arange(n) + 100)
        source, key, piece = rng.integers(0, 20, n), np.arange(n), np.zeros(n, np.int64)
        began = time.perf_counter()
        bins, _, start = packing.pack_shard(words, source, cluster, key, piece, 2048, 4)
        took[n] = time.perf_counter() - began
        assert np.bincount(bins, weights=words).max() <= 2048
        of_hot = bins[cluster == 7]
        assert len(np.unique(of_hot)) == len(of_hot)
    assert took[20_000] < 10 * took[5_000] + 1


def test_hot_clusters_change_no_room(monkeypatch):
    """The room that each piece finds is the same whether its cluster is hot or not: the tightest compatible one."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = 300
        words, cluster, source = rng.integers(1, 300, n), rng.integers(0, 6, n), rng.integers(0, 5, n)
        rows = words, source, cluster, np.arange(n), np.zeros(n, np.int64), 400, 3
        found = []
        for small, hot in ((2, 1000), (10**6, 1)):
            monkeypatch.setattr(packing, "SMALL", small)
            monkeypatch.setattr(packing, "HOT", hot)
            bins, _, start = packing.pack_shard(*rows)
            for b in np.unique(bins):
                held = cluster[bins == b]
                assert len(np.unique(held)) == len(held) and words[bins == b].sum() <= 400
            found.append(len(np.unique(bins)))
        assert abs(found[0] - found[1]) <= 0.03 * found[1] + 2
