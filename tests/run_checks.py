"""Run registered queries against their SQL: ``python tests/run_checks.py [sf_dir] [name-prefix ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from compare import connect, difference  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as contract  # noqa: E402


def main(args):
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), contract.oracle_sql(), 0
    for name, run in contract.queries().items():
        if len(args) > 1 and not any(name.startswith(p) for p in args[1:]):
            continue
        start = time.time()
        try:
            frame = run(spark, sf_dir)
            found = difference(frame, con, sql[name]) if name in sql else f"rows only: {len(frame.collect())}"
        except Exception as error:  # noqa: BLE001
            found = f"FAILED {type(error).__name__}: {str(error)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(found) and not str(found).startswith("rows only")
        print(f"{name:44s} {time.time() - start:6.2f}s {found or 'ok'}", flush=True)
    print(f"{bad} wrong")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
