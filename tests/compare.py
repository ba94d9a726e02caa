"""python tests/compare.py [name ...]: check registered queries against their oracles."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import connect, difference  # noqa: E402

import __spark_entry__ as driver  # noqa: E402
from carrierlake.session import local_session  # noqa: E402

if __name__ == "__main__":
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = driver.queries(), driver.oracle_sql()
    wanted = sys.argv[1:]
    names = [n for n in queries if not wanted or any(n.startswith(w) for w in wanted)]
    con = connect(folder)
    failed = []
    for name in names:
        begin = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problem = difference(df, con, oracles[name])
            else:
                count = df.count()
                problem = None if count else "no rows"
        except Exception as error:
            problem = "".join(traceback.format_exception_only(error))[:1500]
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name} {time.time() - begin:.1f}s{'' if name in oracles else ' (rows only)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(len(names) - len(failed), "ok;", len(failed), "bad:", failed)
