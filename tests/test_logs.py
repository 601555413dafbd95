"""Replays, branches, groups, batches, ingest and pages against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import branches, groups, ingest, pages, replay
from tallyloom.streaming import collect


def replay_brute(log):
    m = {}
    for at, kind, i in log:
        if kind == "clear":
            m.clear()
        elif i is None:
            continue
        elif kind == "write":
            m[i] = (m[i][0], at) if i in m else (at, at)
        elif i in m:
            ids = list(m)
            for x in ids[ids.index(i) :]:
                del m[x]
        else:
            m.clear()
    return [(i, *v) for i, v in m.items()]


def test_replay(spark):
    rng = random.Random(1)
    rows, expected = [], []
    for f in range(150):
        log = [(a, rng.choices(["write", "rewind", "clear"], [8, 2, 0.3])[0], rng.choice([None, *"abcdefgh"])) for a in range(rng.randint(0, 40))]
        rows += [(f, *r) for r in log] + [(f, 99, "other", "a")]
        expected += [(f, *r) for r in replay_brute(log)]
    df = spark.createDataFrame(rows, "f int, at long, kind string, id string")
    found = replay.replayed(df, ["f"], "at", "kind", "id")
    assert sorted(map(tuple, found.select("f", "id", "position", "last").collect())) == sorted(expected)
    assert replay.replayed(df.limit(0), ["f"], "at", "kind", "id").count() == 0


def test_branches(spark):
    """Chains, forks, missing parents and cycles."""
    rng = random.Random(2)
    rows, seen_above, paths = [], [], []
    for f in range(60):
        n = rng.randint(1, 40)
        up = [None if i == 0 or rng.random() < 0.1 else rng.choice([rng.randrange(n), max(0, i - 1), i - 1, i - 1, 99]) for i in range(n)]
        mark = [rng.choice([None, None, None, (f"x{i}",), (None,)]) for i in range(n)]
        for i in range(n):
            rows.append((f, i, up[i], mark[i]))
            seen, p, value = set(), up[i], None
            while p is not None and p not in seen and p < n and value is None:
                seen.add(p)
                value, p = mark[p], up[p]
            seen_above.append((f, i, value))
        at, path = n - 1, []
        while at is not None and at not in path and at < n:
            path.append(at)
            at = up[at]
        paths += [(f, x, d) for d, x in enumerate(path)]
    df = spark.createDataFrame(rows, "f int, n long, up long, m struct<v:string>")
    found = branches.inherited(df, ["f"], "n", "up", {"m": "above"}).collect()
    assert sorted(((r.f, r.n, r.above and (r.above.v,)) for r in found), key=str) == sorted(seen_above, key=str)
    leaves = df.groupBy("f").agg(F.max("n").alias("n"))
    assert sorted(map(tuple, branches.path_to_root(df, leaves, ["f"], "n", "up").collect())) == sorted(paths)


def union_find(pairs):
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            root[find(a)] = find(b)
    members = collections.defaultdict(list)
    for k in root:
        members[find(k)].append(k)
    return sorted((k, min(v)) for v in members.values() for k in v)


def test_linked_groups_whatever_the_order(spark):
    rng = random.Random(3)
    names = [None, *map(str, range(60))]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(45)] + [(str(100 + i), str(101 + i)) for i in range(40)]
    expected = union_find(pairs)
    for _ in range(2):
        rng.shuffle(pairs)
        df = spark.createDataFrame(pairs, "a string, b string").repartition(3)
        assert sorted(map(tuple, groups.linked(df, "a", "b").collect())) == expected
    assert groups.linked(df.limit(0), "a", "b").count() == 0


def test_batches_keep_groups_whole(spark):
    rng = random.Random(4)
    sizes = [rng.choice([1, 2, 3, 7, 40]) for _ in range(120)]
    rows = [(f"g{g}", f"{g:03d}-{i}") for g, n in enumerate(sizes) for i in range(n)]
    found = groups.planned(spark.createDataFrame(rows, "g string, path string"), ["g"], ["path"], 20).collect()
    assert len(found) == len(rows)
    of_group, of_batch = collections.defaultdict(set), collections.defaultdict(set)
    size = collections.Counter()
    for r in found:
        of_group[r.g].add(r.batch)
        of_batch[r.batch].add(r.g)
        size[r.batch] += 1
    assert all(len(b) == 1 for b in of_group.values())
    assert all(n <= 20 or len(of_batch[b]) == 1 for b, n in size.items())
    assert len(size) < len(sizes)


SCHEMA = "conversation_id string, provider string, event_count long, content_hash string, title string"
ROWS = [("a", "p", 3, "h1", "old"), ("a", "p", 5, "h1", "new"), ("b", "q", 1, "h2", "b"), ("c", "p", 1, "h3", "c")]


def stored(spark, store):
    df = spark.createDataFrame([], SCHEMA)
    return sorted(map(tuple, ingest.current(spark, store, df.schema).collect()))


def test_receipts(spark, tmp_path):
    store = str(tmp_path / "store")
    key = collect.batch_receipt("test", 1)
    batch = spark.createDataFrame(ROWS, SCHEMA)
    malformed = spark.createDataFrame([("r", 4)], "provider string, malformed bigint")
    first = {r.provider: r for r in ingest.ingest(batch, store, 7, key, malformed).collect()}
    assert {p: (r.received, r.written, r.skipped, r.malformed, r.duplicates) for p, r in first.items()} == {"p": (2, 2, 0, 0, 1), "q": (1, 1, 0, 0, 0), "r": (0, 0, 0, 4, 0)}
    again = {r.provider: r for r in ingest.ingest(spark.createDataFrame([("z", "p", 9, "h", "z")], SCHEMA), store, 8, key).collect()}
    assert {p: r.run_id for p, r in again.items()} == {p: r.run_id for p, r in first.items()}
    assert stored(spark, store) == sorted([ROWS[1], ROWS[2], ROWS[3]]) and ingest.runs(spark, store).count() == 3
    # without a receipt the same rows are received again, and skipped
    assert [(r.received, r.written, r.skipped) for r in ingest.ingest(batch, store, 9).orderBy("provider").collect()] == [(2, 0, 2), (1, 0, 1)]
    for bad in ("x", key.upper(), "00000000-0000-1000-8000-000000000000"):
        with pytest.raises(ValueError):
            ingest.ingest(batch, store, 9, bad)


def test_a_broken_off_batch_changes_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    ingest.ingest(spark.createDataFrame(ROWS[:2], SCHEMA), store, 1)
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{store}/data/2")  # written, not committed
    assert stored(spark, store) == [ROWS[1]]
    ingest.ingest(spark.createDataFrame(ROWS[2:], SCHEMA), store, 2)
    assert stored(spark, store) == sorted(ROWS[1:])


def test_micro_batches_equal_one_run(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"c{rng.randrange(20)}", rng.choice("pq"), rng.randint(1, 9), f"h{i}", f"t{i}", None) for i in range(60)]
    rows = [(c, "p" if int(c[1:]) % 2 else "q", *rest) for c, _, *rest in rows] + [(None, "p", None, None, None, 3), (None, "q", None, None, None, 1)]
    schema = SCHEMA + ", _malformed bigint"
    source = str(tmp_path / "in")
    tables = []
    for name, parts, files in (("one", 1, 1000), ("three", 3, 1)):
        where = f"{source}-{name}"
        df = spark.createDataFrame(rows, schema)
        df.repartition(parts).write.parquet(where)
        summary = collect.collect(spark, where, df.schema, str(tmp_path / name), str(tmp_path / f"check-{name}"), files)
        assert {r.provider: r.malformed for r in summary.collect()} == {"p": 3, "q": 1}
        tables.append(stored(spark, str(tmp_path / name)))
        before = summary.agg(F.sum("batches")).first()[0]
        again = collect.collect(spark, where, df.schema, str(tmp_path / name), str(tmp_path / f"check-{name}"), files)
        assert again.agg(F.sum("batches")).first()[0] == before
    assert tables[0] == tables[1] and len(tables[0]) == len({r[0] for r in rows} - {None})


def test_upgrade(spark):
    old, new = spark.createDataFrame([(1, "a")], "schema_version int, k string"), spark.createDataFrame([(1, "b", 5), (2, "c", 6), (1, "d", None)], "schema_version int, k string, x bigint")
    ok, refused = ingest.upgraded(old, "x", "bigint")
    assert [tuple(r) for r in ok.collect()] == [(2, "a", None)] and refused.count() == 0
    ok, refused = ingest.upgraded(new, "x", "bigint")
    assert sorted(map(tuple, ok.collect()), key=str) == [(2, "c", 6), (2, "d", None)] and [r.k for r in refused.collect()] == ["b"]


def test_pages_dont_shift(spark, tmp_path):
    path, now = str(tmp_path / "rows"), [0.0]
    spark.range(0, 250).selectExpr("id", "id % 7 AS score").write.parquet(path)
    kept, how = pages.Pages(lambda: now[0]), {"query": {"a": 1}, "sort": "score", "size": 100}
    page, cursor = kept.first(spark.read.parquet(path), [F.col("score"), F.col("id")], **how)
    expected = sorted(((i % 7, i) for i in range(250)))
    got = [[(r.score, r.id) for r in page.orderBy("position").collect()]]
    spark.range(1000, 1100).selectExpr("id", "0 AS score").write.mode("append").parquet(path)
    while cursor:
        page, cursor = kept.next(spark, cursor, **how)
        got.append([(r.score, r.id) for r in page.orderBy("position").collect()])
    assert [len(g) for g in got] == [100, 100, 50] and sum(got, []) == expected
    _, cursor = kept.first(spark.range(300).toDF("id"), [F.col("id")], **how)
    with pytest.raises(ValueError):
        kept.next(spark, cursor, {"a": 2}, "score", size=100)
    now[0] += pages.IDLE_S + 1
    with pytest.raises(LookupError):
        kept.next(spark, cursor, **how)
    assert pages.fingerprint({"b": 1, "a": "é"}, "s", True, 5) == pages.fingerprint({"a": "é", "b": 1}, "s", True, 5) != pages.fingerprint({"a": "é", "b": 1}, "s", False, 5)


def test_rounds_broadcast_nothing(spark):
    nodes = spark.createDataFrame([(1, i, i - 1 if i else None) for i in range(9)], "f int, n long, up long").withColumn("m", F.when(F.col("n") == 0, F.struct(F.lit("a").alias("v"))))
    log = spark.createDataFrame([(1, 1, "write", "a"), (1, 2, "rewind", "a"), (1, 3, "write", "b")], "f int, at long, kind string, id string")
    seen, cut = [], branches.cut

    def watched(df, what):
        seen.append(df)
        return cut(df, what)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(branches, "cut", watched)
        patch.setattr(replay, "cut", watched)
        found = branches.inherited(nodes, ["f"], "n", "up", {"m": "above"})
        branches.path_to_root(nodes, nodes.where("n = 8"), ["f"], "n", "up")
        ends = replay.replayed(log, ["f"], "at", "kind", "id")
        assert found.where("above.v = 'a'").count() == 8 and [tuple(r) for r in ends.collect()] == [(1, "b", 3, 3)]
    for df in [found, *seen]:
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
