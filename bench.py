"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barline.plans import catalog  # noqa: E402
from barline.session import local_session  # noqa: E402

HEADLINE = [
    "agg01_ohlcv_hourly",
    "agg01_ohlcv_brand_daily",
    "win01_sma_strict",
    "win01_sma_ticks",
    "win08_rsi_strict",
    "win13_drawdown_ticks",
    "rec02_ema_recursive",
    "rec02_ema_ticks",
    "rec03_macd_adjusted",
    "rec10_indicator_batch",
    "sig01_rsi_sma",
    "sig16_phi_filter",
    "join01_daily_index_fill",
    "join08_as_of",
    "trd02_first_barrier",
    "agg09_equity_metrics",
    "wfo02_grid_search",
    "dq02_iqr_outliers",
    "txt04_duplicate_flag",
    "txt06_text_score",
    "inf04_mutual_information",
    "rsk01_sentiment_kelly",
    "mlp08_training_set",
    "str01_stream_bars",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session(cpus, scratch=tempfile.mkdtemp(prefix="barline-bench-"))
    catalog.load_all()
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
