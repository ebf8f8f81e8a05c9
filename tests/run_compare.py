"""Run every registered query next to its SQL: ``python tests/run_compare.py <sf_dir> [names]``."""

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from tests.compare import compare, connect  # noqa: E402


def main(sf_dir, *names):
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sql = connect(sf_dir), contract.oracle_sql()
    failed = 0
    for name, run in contract.queries().items():
        if names and name not in names or name not in sql:
            continue
        try:
            difference, times = compare(spark, con, name, run, sql[name], sf_dir)
        except Exception as e:
            difference, times = f"{name}: {type(e).__name__} {str(e)[:900]}", None
        failed += difference is not None
        print(name, times, difference or "same", flush=True)
    print("different:", failed)


if __name__ == "__main__":
    main(*sys.argv[1:])
