"""Workers need no copy of the package: functions travel by value."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
for name in {names!r}:
    print(name, len(e.queries()[name](spark, "/root/testdata/sf0.001").collect()))
"""


def run_elsewhere(tmp_path, names):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", CODE.format(repo=repo, names=names)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr[-2000:]
    return got.stdout.split()


def test_queries_run_without_the_package_on_the_path(tmp_path):
    assert run_elsewhere(tmp_path, ["feature_hash", "text_context_split"])[0::2] == ["feature_hash", "text_context_split"]
