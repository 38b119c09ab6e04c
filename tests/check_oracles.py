"""Run registered queries against DuckDB: ``python tests/check_oracles.py SF_DIR [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import connect, differences  # noqa: E402

import __spark_entry__ as registry  # noqa: E402
from panelwright.session import build_session  # noqa: E402


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(
        "oracle check",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    connection, oracles = connect(sf_dir), registry.oracle_sql()
    failed = 0
    for name, query in registry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = query(spark, sf_dir).toPandas()
            taken = time.time() - start
            if name in oracles:
                problem = differences(got, connection.execute(oracles[name]).df())
            else:
                problem = "" if len(got) else "no rows"
        except Exception as error:  # report and go on with the other queries
            taken, problem = time.time() - start, f"{type(error).__name__}: {str(error)[:500]}"
        failed += bool(problem)
        kind = "oracle" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {name:34} {kind:6} {len(got):8} {taken:6.2f}s {problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
