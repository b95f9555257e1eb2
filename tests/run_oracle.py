"""Full sweep: every registered query vs its DuckDB oracle.

usage: python tests/run_oracle.py [sf_dir] [key ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_harness import compare, duck  # noqa: E402


def main():
    from sluice.session import build_session
    import __spark_entry__ as E

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    spark = build_session()
    q, o = E.queries(), E.oracle_sql()
    con = duck(sf)
    bad = 0
    for k in keys or list(q):
        t = time.time()
        try:
            if k in o:
                probs, n = compare(spark, k, q[k], o[k], sf, con)
            else:
                n, probs = q[k](spark, sf).count(), []
            tag = "OK " if not probs else "BAD"
            bad += bool(probs)
            print(f"{tag} {k:28s} rows={n:<7} {time.time() - t:6.1f}s {'' if k in o else '(rows only)'} "
                  f"{'; '.join(probs)[:400]}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR {k:28s} {type(e).__name__}: {str(e)[:400]}", flush=True)
    print("failures:", bad)
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
