"""Command line: compare some or all registered queries with their SQL.

python tests/run_oracle.py FOLDER [NAME_PART ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_points  # noqa: E402
from tablewright.session import build_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    folder, parts = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                       "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry_points.oracle_sql()
    bad = 0
    for name, query in entry_points.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            df = query(spark, folder)
            if name in oracles:
                found = compare(df, oracles[name], con)
                state = "ok" if not found else "DIFF"
            else:
                found, state = [], f"rows {df.count()}"
        except Exception as exc:  # report and go on
            found, state = [str(exc)[:600]], "ERROR"
        bad += state in ("DIFF", "ERROR")
        print(f"{state:8} {name} {time.time() - started:.1f}s", flush=True)
        for line in found[:4]:
            print("    ", line[:500])
    print("failed:", bad)
    spark.stop()
