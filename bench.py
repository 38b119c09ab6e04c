"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local threads. Each query builds its plan and
runs whole into a no-op sink, fitting jobs included, without the rounding that comparisons need. It runs
twice and the second, warm run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelwright.catalog import queries as catalog  # noqa: E402
from panelwright.session import build_session  # noqa: E402

HEADLINE = (
    "walk_forward_bounds",
    "walk_forward_assign",
    "trailing_window",
    "payload_explode",
    "parquet_roundtrip",
    "technical_indicators",
    "sma_long",
    "macd",
    "event_history",
    "event_history_hot_keys",
    "turnover_positions",
    "lag_features",
    "rolling_stats",
    "winsorize_panel",
    "impute_median",
    "impute_mode",
    "standard_scale",
    "equity_curve_pooled",
    "equity_curve_by_symbol",
    "strategy_report",
    "strategy_report_by_symbol",
    "profile",
    "feature_matrix",
    "elastic_net_coefficients",
    "train_job",
    "backtest_job",
)
#: Runs first and uncounted, so that starting the JVM falls on no query.
WARM_UP = "panel_project"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.rounded = lambda df, *_, **__: df
    queries, seconds = catalog.all_queries(), {}
    queries[WARM_UP](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        runs = []
        while len(runs) < 2:
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(runs[-1], 3)
        print(name, [round(x, 2) for x in runs], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
