"""Run registered queries against DuckDB: python tests/check_oracles.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from compare import differences, duck  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tableviews.session import local_session  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    con = duck(sf_dir)
    oracles, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                diff = differences(df, con, oracles[name])
                empty = "" if df.limit(1).count() else "EMPTY "
            else:
                diff, empty = None, f"no oracle, {df.count()} rows "
        except Exception as exc:  # noqa: BLE001
            diff, empty = f"{type(exc).__name__}: {str(exc)[:600]}", ""
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {empty}{time.time() - t:.1f}s {diff or ''}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
