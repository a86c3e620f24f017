"""Python workers without the package on their path, and the shared folder."""
import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from tabulon.sources.scratch import scratch

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})  # the driver's path only
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
def blind(batches):
    import importlib.util
    for b in batches:
        assert importlib.util.find_spec("tabulon") is None
        yield b
assert spark.range(3).mapInArrow(blind, "id long").count() == 3
import __spark_entry__
for name in ("op3_packing", "op4_substring_dedup", "op5_toxicity", "op6_tiff", "op7_byte_bpe", "op8_quality", "op9_near_dedup"):
    assert __spark_entry__.queries()[name](spark, {data!r}).count() >= 200, name
print("all ran")
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, data="/root/testdata/sf0.001")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_shared_folder_is_asked_for_on_a_cluster(tmp_path):
    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: folder), sparkContext=SimpleNamespace(master=master))

    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            scratch(session(master))
        assert scratch(session(master, "hdfs://x/shared/")).startswith("hdfs://x/shared/tabulon/")
    assert scratch(session("local[2]")).startswith("file:///") and scratch(session("local[2]")) != scratch(session("local[2]"))
