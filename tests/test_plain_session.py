"""A session without spark.checkpoint.dir, in a process of its own, since the setting can't be unset in a running one."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
{body}
"""


def run(tmp_path, body):
    (tmp_path / "conf").mkdir()
    import os

    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), body=body)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


def test_stored_tables_need_no_setting(tmp_path):
    body = """
from tallyloom.plans import catalog
from tallyloom.sources.store import shared_dir
print(catalog.queries()["providers_overview"](spark, "/root/testdata/sf0.001").count(), shared_dir(spark) == shared_dir(spark))
"""
    assert run(tmp_path, body).split()[-2:] == ["6", "True"]
