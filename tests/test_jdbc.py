"""Databases that live in the driver, on a master whose executors are other processes."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF

CHILD = """
import json, sys
from pyspark.sql import SparkSession
work, root, sf = sys.argv[1:]
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", f"{work}/warehouse").config("spark.checkpoint.dir", f"file://{work}/shared").getOrCreate()
from quern import queries
from quern.sources import jdbc
out = {"query": sorted(map(list, queries.QUERIES["jdbc_round_trip"](spark, sf).collect()))}
own = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
url = "jdbc:derby:memory:held;create=true"
rows = spark.range(0, 1000, 1, 7).selectExpr("id AS k", "IF(id % 3 = 0, NULL, concat('é', id)) AS name", "id / 8 AS part", "CAST(id / 8 AS DECIMAL(10, 3)) AS exact", "date_add(DATE'2020-02-28', CAST(id AS INT)) AS day", "id % 2 = 0 AS even")
jdbc.ROWS_A_BLOCK = 300  # four blocks
jdbc.write(rows, url, "t", batch=64, **own)
read = lambda: jdbc.read(spark, url, "t", "k", **own)
key = lambda df: sorted(map(str, df.collect()))
out["same"] = key(read()) == key(rows) and read().dtypes == rows.dtypes
jdbc.write(rows, url, "t", "ignore", **own)
out["ignored"] = read().count()
try:
    jdbc.write(rows, url, "t", **own)
except Exception as x:
    out["error"] = "already exists" in str(x) or "ALREADY_EXISTS" in str(x)
jdbc.write(rows.filter("k < 5"), url, "t", "append", **own)
out["appended"] = read().count()
jdbc.write(rows.filter("k < 5"), url, "t", "overwrite", **own)
out["overwritten"] = read().count()
jdbc.write(rows.filter("k < 0"), url, "bare", **own)
out["empty"] = [jdbc.read(spark, url, "bare", "k", **own).count(), jdbc.read(spark, url, "bare", **own).columns]
print("FOUND" + json.dumps(out))
"""


def test_drivers_database_on_a_cluster(tmp_path):
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", CHILD, str(tmp_path), ROOT, SF], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    found = [x for x in done.stdout.splitlines() if x.startswith("FOUND")]
    assert found, done.stderr[-2000:]
    assert json.loads(found[0][5:]) == {
        "query": [[n, f"NATION_{n}"] for n in (2, 7, 12, 17, 22)], "same": True, "ignored": 1000, "error": True, "appended": 1005, "overwritten": 5, "empty": [0, ["k", "name", "part", "exact", "day", "even"]],
    }
