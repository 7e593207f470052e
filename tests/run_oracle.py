"""Ad-hoc runner: python tests/run_oracle.py [sf] [name-prefix ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.dirname(__file__))

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, connect  # noqa: E402

from tallyframe.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    good = bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                clock = {}
                problem = compare(df, con, oracles[name], clock)
                rows = f" spark={clock.get('spark', 0):.2f} duck={clock.get('duck', 0):.2f} rows={clock.get('rows')}"
            else:
                problem, rows = None, f" rows={df.count()} (no sql)"
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", ""
        took = time.time() - began
        print(f"{'ok ' if problem is None else 'BAD'} {took:6.2f}s {name}{rows} {problem or ''}", flush=True)
        good, bad = good + (problem is None), bad + (problem is not None)
    print(f"{good} good, {bad} bad")
