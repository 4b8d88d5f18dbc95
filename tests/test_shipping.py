import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from __spark_entry__ import entry, queries
assert entry(spark).collect()
assert queries()["metrics_bands"](spark, "/root/testdata/sf0.001").collect()
print("shipped")
"""


def test_tasks_import_the_package_from_any_folder(tmp_path):
    """A plain session, started in another folder: the workers still find the kernels."""
    repo = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "shipped" in done.stdout, done.stderr[-2000:]
