import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import scalars as X
from tallyloom.operators import folds, merge, metrics, selection, slices

W = selection.Window(100, 200)


def test_windows_of_dates_and_times():
    w = selection.Window.parse("2026-08-01", "2026-08-03")
    assert w.until - w.since == 3 * X.DAY_MS
    assert selection.parse_bound("2026-08-01T23:30:00-02:00") == selection.parse_bound("2026-08-02") + 90 * 60_000
    with pytest.raises(ValueError):
        selection.parse_bound("2026-08-01T10:00:00")
    with pytest.raises(ValueError):
        selection.Window.parse("2026-08-03", "2026-08-01")


def test_times_are_rounded_to_milliseconds(spark):
    times = ["2024-01-01 00:09:58.778549", "2024-01-01 00:00:00.0004", "2024-01-01 00:00:00.0005", "2024-01-01 23:59:59.9999", "1969-12-31 23:59:59.9994", "1969-12-31 23:59:59.9985", None]
    df = spark.createDataFrame([(t,) for t in times], "t string").select("t", X.epoch_ms("CAST(t AS TIMESTAMP_NTZ)").alias("ms"))
    con = duckdb.connect()
    for t, ms in df.collect():
        assert ms == con.execute("SELECT epoch_ms(CAST(? AS TIMESTAMP))", [t]).fetchone()[0], t


def test_server_and_client_windows_differ_on_missing_ends(spark):
    rows = [("overlap", 50, 150), ("inside", 120, 130), ("after", 200, 250), ("start only inside", 150, None), ("end only inside", None, 150), ("start only before", 50, None), ("end only after", None, 250), ("unknown", None, None), ("ends at since", 50, 100), ("ends before", 50, 99)]
    df = spark.createDataFrame(rows, "name string, started_ms long, ended_ms long")
    assert {r.name for r in df.where(selection.overlaps(W)).collect()} == {"overlap", "inside", "start only inside", "end only inside", "ends at since"}
    client = {r.name for r in df.where(slices.overlaps(slices.Range(100, 199))).collect()}
    assert client == {"overlap", "inside", "start only inside", "end only inside", "start only before", "end only after", "ends at since"}
    assert df.where(selection.overlaps(selection.Window())).count() == len(rows)


def test_active_time_and_concurrency(spark):
    turns = spark.createDataFrame([("m", 0, 10), ("m", 10, 20), ("m", 5, 12), ("m", 30, 40), ("n", 0, 5), ("n", 5, 9), ("n", 7, None)], "machine string, started_ms long, ended_ms long")
    assert {r.machine: r.active_ms for r in metrics.active_time(turns, "machine").collect()} == {"m": 30, "n": 9}
    assert {r.machine: r.peak for r in metrics.peak_concurrency(turns, "machine").collect()} == {"m": 2, "n": 1}


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([(10,), (20,), (None,)], "x int")
    assert df.agg(metrics.percentile("x", 0.5)).first()[0] == 15
    assert df.where("x > 99").agg(metrics.percentile("x", 0.5)).first()[0] is None


def test_merging_in_any_order_gives_the_same(spark):
    copies = [spark.createDataFrame([(1, n, h), (2, 5, h)], "conversation_id int, event_count int, content_hash string") for n, h in ((3, "a"), (3, "b"), (2, "z"))]
    seen = set()
    for order in ((0, 1, 2), (2, 1, 0), (1, 0, 2)):
        now = copies[order[0]]
        for i in order[1:]:
            now = merge.merge(now, copies[i])
        seen.add(tuple(sorted(map(tuple, merge.merge(now, copies[order[0]]).collect()))))
    assert seen == {((1, 3, "b"), (2, 5, "z"))}


def test_as_of_takes_the_last_mark_and_none_before_the_first(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 10), ("a", 3, 25), ("a", 4, None), ("b", 5, 5)], "k string, id int, t int")
    marks = spark.createDataFrame([("a", 10, "x"), ("a", 20, "y")], "k string, t int, turn string")
    found = folds.as_of(rows, marks, ["k"], "t", "turn").collect()
    assert {r.id: r.turn for r in found} == {1: None, 2: "x", 3: "y", 4: "y", 5: None}


def test_ancestors_of_chains_and_cycles(spark):
    nodes = spark.createDataFrame([(1, None, 5), (2, 1, 9), (3, 2, 1), (4, 3, 2), (7, 8, 1), (8, 7, 1)], "node int, parent int, mark int")
    found = {r.node: (r.depth, r.largest) for r in folds.ancestors(nodes, 3).collect()}
    assert [found[i] for i in (1, 2, 3, 4)] == [(0, 5), (1, 9), (2, 9), (3, 9)] and found[7][0] is None


@settings(max_examples=20, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(allow_nan=True, allow_infinity=True), st.integers(-5, 2**63 - 1).map(float)), min_size=1, max_size=8))
def test_counters(spark, xs):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(X.counter(F.col("x"))).collect()]
    for x, c in zip(xs, got, strict=True):
        expected = 0 if x is None or x != x or x in (float("inf"), float("-inf")) or x <= 0 else min(int(x), 2**63 - 1)
        assert c == expected


def test_scalars(spark):
    row = spark.sql("SELECT '2026-08-01T23:30:00.5-02:00' AS t, '2026-08-01T23:30:00' AS naive, ' a/b ' AS l, '-x y' AS bad, 5 AS five, CAST(NULL AS INT) AS nothing").select(
        X.canonical_time(F.col("t")), X.canonical_time(F.col("naive")), X.label(F.col("l")), X.label(F.col("bad")), X.change(F.col("five"), F.col("nothing")), X.ratio(F.col("five"), F.lit(0)), X.neutralized(F.lit(" =1")), X.script_safe(F.lit("<a&b>")), X.bounded_sum(F.lit(2**63 - 1), F.lit(5)), X.interval_ms(F.lit(9), F.lit(5)),
    ).first()
    assert tuple(row) == ("2026-08-02T01:30:00.500000+00:00", None, "a/b", None, None, 0.0, "' =1", "\\u003ca\\u0026b\\u003e", 2**63 - 1, 0)


def test_ranges_within_an_export_window(spark):
    from tallyloom.operators import slices

    day = 86_400_000
    latest = spark.createDataFrame([(10 * day + 5,)], "at long")
    assert tuple(slices.ranges(latest, 3).select("start_ms", "end_ms", "previous_start_ms", "previous_end_ms").first()) == (8 * day, 11 * day - 1, 5 * day, 8 * day - 1)
    assert tuple(slices.ranges(latest, 3, since=7 * day, until=10 * day).select("start_ms", "end_ms", "previous_start_ms").first()) == (7 * day, 10 * day - 1, None)
    assert tuple(slices.ranges(latest, None).select("start_ms", "end_ms", "previous_start_ms").first()) == (None, 11 * day - 1, None)
    assert slices.ranges(spark.createDataFrame([(None,)], "at long"), 3).count() == 0
    assert slices.last_days(7, 10 * day + 5) == slices.Range(4 * day, 11 * day)


def test_united_graphs(spark):
    from tallyloom.sources.assemble import Bundle, united

    frame = lambda *rows: spark.createDataFrame([(r,) for r in rows], "x long")
    both = united([Bundle(*[frame(1, 2)] * 6), Bundle(*[frame(3)] * 6)])
    assert all(sorted(r.x for r in df.collect()) == [1, 2, 3] for df in (both.conversations, both.compactions))


def test_window_metadata():
    from tallyloom.operators import selection

    w = selection.Window(90_000_000, 172_800_000)
    assert selection.metadata(w) == {"since": "1970-01-02T01:00:00.000000+00:00", "until": "1970-01-03T00:00:00.000000+00:00"}
    assert selection.metadata(w, True) == {"since": "1970-01-02T00:00:00.000000+00:00", "until": "1970-01-03T00:00:00.000000+00:00"}
    assert selection.metadata(selection.Window(None, 1), True) == {"since": None, "until": "1970-01-02T00:00:00.000000+00:00"}
