"""Registered queries against their SQL at the smallest scale.

BARLINE_ALL=1 runs every query; the default is one or two of each group.
"""

import os
import re

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SOME = """win01_sma_ticks win08_rsi_strict win17_fill rec02_ema_ticks rec03_macd_adjusted rec06_wilder_atr sig05_additive
pat01_engulfing join01_daily_index_fill join08_as_of_user join09_barrier_join agg01_ohlcv_hourly agg08_trade_summary
prj13_record_rules dq02_iqr_outliers dq11_clean txt06_text_score inf05_transfer_entropy rsk02_fractional_kelly trd02_wide_barrier trd07_bootstrap
wfo12_best_profit mlp01_split mlp06_augment mlp08_training_set set06_overlay src07_funding snk01_parquet str01_stream_bars udf02_per_series""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.catalog.QUERIES) if os.environ.get("BARLINE_ALL") else SOME)
def test_query_equals_sql(spark, con, name):
    status, note = compare(spark, con, name, FOLDER)
    if status == "EMPTY":  # too few rows at the smallest scale for this query
        status, note = compare(spark, connect(LARGER), name, LARGER)
    assert status == "ok", (status, note)


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 240
    own = {name for name in queries if not re.match(r"op\d+_|pipeline$", name)}
    assert own <= set(sql)
