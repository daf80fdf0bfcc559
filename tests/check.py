"""Command line: run registered queries against their SQL twins at one scale factor.

``python -m tests.check [sf] [name-substring ...]``
"""

import sys
import time

from tests.compare import compare, duck
from tests.conftest import local_session


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, bad = local_session(), duck(sf_dir), 0
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and not any(p in name for p in sys.argv[2:]):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            verdict = compare(df, con, oracles[name]) if name in oracles else f"rows-only {df.count()}"
        except Exception as exc:  # report and go on
            verdict = f"ERROR {str(exc)[:600]}"
        ok = verdict is None or verdict.startswith("rows-only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - start:6.2f}s {name} {verdict or ''}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
