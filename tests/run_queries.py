"""``python tests/run_queries.py [name …]``: compare queries with their SQL and print times."""

import os
import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from oracle import connect, differences  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402

QUERIES, ORACLES = queries(), oracle_sql()

sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
spark = (
    SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false")
    .config("spark.driver.memory", "12g").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf)
bad = 0
for name in sys.argv[1:] or QUERIES:
    t = time.time()
    try:
        df = QUERIES[name](spark, sf)
        report = differences(df, con, ORACLES[name]) if name in ORACLES else f"(rows only) {df.count()}"
    except Exception as e:  # noqa: BLE001
        report = f"{type(e).__name__}: {str(e)[:1500]}"
    ok = not report or report.startswith("(rows")
    bad += not ok
    print(f"{'ok  ' if ok else 'FAIL'} {name:26s} {time.time() - t:6.1f}s {report}", flush=True)
print(f"{bad} failed")
