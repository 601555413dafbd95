import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tallyloom.llm import stream_dedup

ROWS = [(5, "a"), (9, "a"), (2, "b"), (7, ""), (8, None), (None, "c"), (3, "c"), (4, "d"), (None, "e"), (6, "f" * 100_000), (11, "f" * 100_000), (12, "a "), (12, "a ")]


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, tmp_path, rows, **more):
    path = str(tmp_path / "documents.parquet")
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS file", "1 AS size", "2 AS digest")
    df.repartition(4).write.parquet(path)
    return sorted(map(tuple, stream_dedup.dedup(spark, path, **more).collect()), key=str)


def test_groups(spark, tmp_path):
    assert run(spark, tmp_path, ROWS) == expected(ROWS)


def test_many_batches_give_the_same(spark, tmp_path):
    assert run(spark, tmp_path, ROWS, bytes_per_trigger=1) == expected(ROWS)


def test_bytes_are_checked_when_digests_collide(spark, tmp_path):
    weak = lambda text: F.length(text).cast("string")
    assert run(spark, tmp_path, ROWS, digest=weak) == expected(ROWS)


def test_state_goes_on_after_more_files(spark, tmp_path):
    path, out, check = (str(tmp_path / x) for x in ("docs", "ledger", "check"))
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(path)
    stream_dedup.run_stream(spark, path, out, check)
    spark.createDataFrame([(3, "a")], "doc_id long, text string").write.mode("append").parquet(path)
    stream_dedup.run_stream(spark, path, out, check)
    found = stream_dedup.newest(spark, out, spark.read.parquet(path).schema["doc_id"].dataType)
    assert sorted((r.size, r.kept.id) for r in found.collect()) == [(1, 2), (2, 3)]


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_a_table_of_one_file(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    df.toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet", index=False)
    found = stream_dedup.dedup(spark, str(tmp_path / "documents.parquet")).collect()
    assert sorted(map(tuple, found), key=str) == expected(ROWS)
