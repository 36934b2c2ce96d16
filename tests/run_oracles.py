"""Run registered queries against their DuckDB oracles: python tests/run_oracles.py [sf_dir] [key ...]"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harness import compare, duck  # noqa: E402

from verba.plans import catalog  # noqa: E402
from verba.session import get_spark  # noqa: E402


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = get_spark()
    qs, os_ = catalog.queries(), catalog.oracles()
    keys = args or list(qs)
    con = duck(sf)
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            df = qs[k](spark, sf)
            if k in os_:
                r = compare(df, con, os_[k])
            else:
                r = {"rows_spark": df.count(), "oracle": None}
        except Exception as e:  # report and go on
            r = {"error": repr(e)[:600]}
        r["sec"] = round(time.time() - t0, 2)
        ok = r.get("hash_match") or (r.get("oracle", 1) is None and "error" not in r)
        bad += not ok
        print(("OK  " if ok else "BAD ") + k, json.dumps(r, default=str)[:1500], flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
