"""Prints match and time of every query: python tests/check.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]

import compare  # noqa: E402
import __spark_entry__ as entry  # noqa: E402
from emberfield.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con, oracle = local_session(), compare.connect(sf_dir), entry.oracle_sql()
    for name in names:
        start = time.time()
        try:
            got = compare.from_spark(entry.queries()[name](spark, sf_dir))
            took = time.time() - start
            note = (
                compare.difference(got, compare.from_duckdb(con, oracle[name]))
                if name in oracle else f"rows only: {got[1][:2]}"
            )
        except Exception as problem:
            took, got = time.time() - start, ((), ())
            note = f"FAILED {type(problem).__name__}: {str(problem)[:600]}"
        print(f"{name:26s} {took:6.1f}s {len(got[1]):6d} rows  {note or 'match'}", flush=True)


if __name__ == "__main__":
    main()
