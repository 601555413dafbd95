import os
import types

from tallyloom.operators import slices
from tallyloom.plans import catalog, derive
from tallyloom.plans.derive import Graph
from tallyloom.sources import store

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


def test_changed_files_are_another_source(spark, tmp_path):
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (df.where("o_orderkey % 2 = 0") if t == "orders" else df).write.parquet(f"{tmp_path}/{t}.parquet")
    count = lambda: Graph(spark, str(tmp_path)).conversations.count()
    half, source = count(), Graph(spark, str(tmp_path)).source
    assert count() == half and Graph(spark, str(tmp_path)).source == source
    spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey % 2 = 1").write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    assert count() == spark.read.parquet(f"{SF}/orders.parquet").count() > half and Graph(spark, str(tmp_path)).source != source


def test_forget_deletes(spark, tmp_path):
    before = set(store._STORED)
    found = store.stored(spark.range(10), f"{tmp_path}@x", "numbers", "id")
    path = found.inputFiles()[0].removeprefix("file://")
    assert found.count() == 10
    store.forget(spark, str(tmp_path))
    assert set(store._STORED) == before and not os.path.exists(path)


def test_slices_shuffle_no_facts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(derive, "BUCKET_BYTES", 10_000)
    monkeypatch.setattr(Graph, "source", f"{tmp_path}@x")  # its own tables, with as many buckets
    g = Graph(spark, SF)
    assert g.buckets == 1 + os.path.getsize(f"{SF}/lineitem.parquet") // 10_000 > spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = catalog.year(g)
        calls = slices.semantic_calls(s).join(s.conversations.select("conversation_id", "project"), "conversation_id")
        for df, inputs in ((calls, "conversation_id"), (s.turns, "conversation_id"), (s.settings, "conversation_id")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
            assert df.rdd.getNumPartitions() == g.buckets and df.select(inputs).distinct().count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        store.forget(spark, str(tmp_path))


def test_calls_without_kept_turns_are_sliced_alike(spark):
    g = Graph(spark, SF)
    plain = types.SimpleNamespace(**{n: getattr(g, n) for n in ("conversations", "turns", "calls", "tools", "work", "samples", "settings", "compactions", "subagents")})
    for model in (None, catalog.MODEL):
        ours, theirs = (slices.select(x, catalog.YEAR, model=model) for x in (g, plain))
        for a, b in ((slices.semantic_calls(ours), slices.semantic_calls(theirs)), (ours.settings, theirs.settings)):
            assert a.columns == b.columns or set(a.columns) == set(b.columns)
            assert a.count() == b.count() > 0 and a.exceptAll(b.select(a.columns)).isEmpty()


def test_a_bucket_is_written_by_one_task(spark, tmp_path):
    """A table that is derived from one with the same buckets isn't read by files of a size, whose tasks hold several buckets."""
    numbers = store.stored(spark.range(1000), f"{tmp_path}@x", "numbers", key="id", buckets=40)
    derived = store.stored(numbers.selectExpr("id", "spark_partition_id() AS part"), f"{tmp_path}@x", "derived", "part", key="id", buckets=40)
    try:
        assert derived.select("part").distinct().count() == 40 and derived.count() == 1000
        assert spark.conf.get(store._BY_SIZE) == "true"
    finally:
        store.forget(spark, str(tmp_path))
