"""Command line: python tests/run_oracles.py [folder] [name ...] compares queries with their SQL."""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from pulsefleet.session import local_session  # noqa: E402
from tests import compare  # noqa: E402


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session()
    if os.environ.get("SEGMENT_ROWS"):  # force the segmented plans on small data
        spark.conf.set("spark.pulsefleet.segmentRows", os.environ["SEGMENT_ROWS"])
    connection = compare.connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:]
    names = [n for n in queries if not wanted or any(n.startswith(w) for w in wanted)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = compare.spark_rows(queries[name](spark, folder))
            spent = time.time() - start
            if name not in oracles:
                print(f"ROWS {name} {len(got[1])} rows {spent:.1f}s", flush=True)
                continue
            problem = compare.difference(got, compare.sql_rows(connection, oracles[name]))
        except Exception as error:  # report and go on with the next query
            problem, spent, got = f"{type(error).__name__}: {str(error)[:700]}", time.time() - start, (None, [])
        bad += problem is not None
        print(f"{'BAD ' + problem if problem else 'ok'} {name} {len(got[1])} rows {spent:.1f}s", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
