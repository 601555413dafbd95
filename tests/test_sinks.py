import csv
import json
from pathlib import Path

from tallyloom.sources import sinks

ROWS = [(2, "=1+1", ["b"], None), (1, "plain, \"q\"", [], 5), (3, None, ["<x>"], 7)]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id int, name string, models array<string>, cache_write_1h_input_tokens int")
    sinks.write_csv(df, ["id"], str(tmp_path / "t"), single_file=True)
    (part,) = Path(tmp_path / "t").glob("part-*.csv")
    with part.open(newline="") as f:
        assert list(csv.reader(f)) == [["id", "name", "models"], ["1", 'plain, "q"', "[]"], ["2", "'=1+1", '["b"]'], ["3", "", '["<x>"]']]
    assert b"\r\n" in part.read_bytes()


def test_dataset(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id int, name string, models array<string>, cache_write_1h_input_tokens int")
    sinks.write_dataset({"a": df, "b": df.select("id")}, str(tmp_path / "d"))
    lines = [x for p in Path(tmp_path / "d" / "section=a").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(json.loads(x)["id"] for x in lines) == [1, 2, 3] and not any("<" in x for x in lines)
    assert {r.section for r in spark.read.text(str(tmp_path / "d")).select("section").collect()} == {"a", "b"}
