"""What only executors in processes of their own can show."""

import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
RUN = """
import os, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__ as entry
conf = {"spark.executor.memory": "900m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{sys.argv[3]}/shared", "spark.sql.warehouse.dir": f"{sys.argv[3]}/warehouse"}
spark = SparkSession.builder.master("local-cluster[2,1,1500]").config(map=conf).getOrCreate()
print("FOUND", entry.queries()[sys.argv[4]](spark, sys.argv[2]).count(), flush=True)
os._exit(0)
"""


def test_executors_of_their_own_read_the_database(spark, sf, tmp_path):
    want = spark.read.parquet(f"{sf}/supplier.parquet").filter("s_acctbal > 0").count()
    out = subprocess.run([sys.executable, "-c", RUN, ROOT, sf, str(tmp_path), "io_jdbc"], capture_output=True, text=True, timeout=180)
    assert f"FOUND {want}\n" in out.stdout, out.stderr[-2000:]
