"""Command line: compare queries with their SQL. Usage: run_oracle.py [sf_dir] [name ...]"""

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from topicweave.session import local_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    for name in args or qs:
        t = time.time()
        try:
            df = qs[name](spark, sf)
            if name in sqls:
                bad = oracle.compare(df, con, sqls[name])
                n = "ok" if not bad else f"DIFF {bad}"
            else:
                n = f"rows-only {len(df.collect())}"
        except Exception as e:
            n = f"ERROR {type(e).__name__} {str(e)[:700]}"
        print(f"{name:28s} {time.time() - t:6.2f}s {n}", flush=True)


if __name__ == "__main__":
    main()
