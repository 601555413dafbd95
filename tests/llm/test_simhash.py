import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import simhash
from tallyloom.llm.queries import op12_simhash_near_dedup


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """(id, fingerprint, component) by comparing all pairs."""
    marks = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(marks[i] ^ marks[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, f"{m:016x}", least.get(find(i))) for i, ((d, _), m) in enumerate(zip(rows, marks))), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aB c\n\x0b\x1c\x85\xa0é"), st.characters(exclude_categories=["Cs"])), max_size=80), min_size=1, max_size=5), st.integers(1, 20))
def test_fingerprints(texts, size):
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    before, simhash.TEXT_BYTES = simhash.TEXT_BYTES, size  # texts in many parts
    try:
        found = simhash.fingerprints(np.frombuffer(b"".join(raw), np.uint8), offs)
    finally:
        simhash.TEXT_BYTES = before
    assert found.tolist() == [plain_fingerprint(t) for t in texts]


def test_coordinates_never_discard_a_near_pair():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    flips = np.zeros(len(x), np.uint64)
    for _ in range(2):
        flips |= np.where(rng.random(len(x)) < 0.8, np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64), np.uint64(0))
    y = x ^ flips
    tx, ty = simhash.distance_table(x), simhash.distance_table(y)
    both, n = np.concatenate([x, y]), len(x)
    assert simhash.survivors(both, np.concatenate([tx, ty]), np.arange(n), np.arange(n) + n).all()
    assert (simhash.meeting_keys(tx) == simhash.meeting_keys(ty)).any(axis=1).all()
    other = np.roll(y, 1)
    assert (np.abs(tx.astype(int) - simhash.distance_table(other)).max(axis=1) > 2).mean() > 0.99


def near_rows():
    """Families of near copies, one of them larger than a group that is compared by tables, and rows of every odd kind."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(None, None), (900, ""), (901, " \n"), (None, "only null"), (None, "only null"), (902, "two words"), (903, "TWO words"), (904, "x" * 50_000), (905, "a " * 60_000)]
    for family, size in enumerate([150, 30, 5, 3, 2, 2]):
        base = [rng.choice(vocabulary) for _ in range(300)]
        for i in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(300)] = rng.choice(vocabulary)
            rows.append((1000 * family + i + 1, " ".join(words)))
    rows += [(20_000 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    rows += rows[30:34]
    rng.shuffle(rows)
    return rows


def test_components_against_all_pairs(spark, tmp_path):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fingerprint", "2 AS node", "3 AS id").repartition(5)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    query = op12_simhash_near_dedup(spark, str(tmp_path))
    assert dict(query.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in query.collect()), key=str)
    assert found == brute(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_dense_groups_without_all_pairs(spark):
    """Thousands of nodes under one key: links by points, rows in proportion to nodes."""
    rng = np.random.default_rng(2)
    low = np.unique(rng.integers(0, 1 << 14, 3000)).astype(np.int64)  # 14 free bits: every node shares two segments with all others
    nodes = spark.createDataFrame([(int(x),) for x in low], "node long")
    met = simhash._meet(simhash._tables(nodes)).collect()
    points = {r.u for r in met if r.v is None}
    assert points == set(low.tolist()) and len(met) < 40 * len(low)
    links = {(r.u, r.v) for r in simhash._balls(nodes).collect()}
    near = {(a, b) for a in low[:200].tolist() for b in low[:200].tolist() if a < b and bin(a ^ b).count("1") <= 2}
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(sorted(links), "u long, v long")).collect()}
    assert all(bin(a ^ b).count("1") <= 2 for a, b in links) and all(roots.get(a, a) == roots.get(b, b) for a, b in near)
