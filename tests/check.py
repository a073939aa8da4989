"""Run registered queries against their SQL: python tests/check.py [sf_dir] [name part ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests import oracle  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = query(spark, sf)
            note = oracle.difference(df, con, sql[name]) if name in sql else f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            note = f"{type(error).__name__}: {str(error)[:1500]}"
        ok = note is None or note.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name} {time.time() - start:.2f}s {note or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
