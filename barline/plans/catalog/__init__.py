"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from barline.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

GROUPS = (
    "windows recurrence signals joins aggregates projection quality text info risk trades search mlprep "
    "sources streaming udf"
).split()

# SQL building blocks shared by the checks.
BARS = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open,
  max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2)"""
DAYS = BARS.replace("bars AS", "days AS").replace("'hour'", "'day'")
BRANDS = """brands AS (SELECT p_brand AS symbol, date_trunc('day', l_shipdate) AS ts,
  arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
W = "(PARTITION BY symbol ORDER BY ts)"


def rows(n: int, order: str = "ts") -> str:
    return f"(PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def strict(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {rows(n)} >= {n} THEN {agg}({x}) OVER {rows(n)} END"


def rounded_sql(inner: str, keys: str, values: str = "") -> str:
    """Select keys as they are and values rounded to six places; ``ts`` becomes ``ts_s``.

    The billionth keeps exact halves (means over 8 or 16 rows) from rounding apart in the two engines.
    """
    cols = []
    for k in filter(None, (c.strip() for c in keys.split(","))):
        cols.append("epoch(ts)::BIGINT AS ts_s" if k == "ts" else k)
    for v in filter(None, (c.strip() for c in values.split(","))):
        cols.append(f"round(({v})::DOUBLE + 1e-9, 6) + 0.0 AS {v}")
    return f"SELECT {', '.join(cols)} FROM ({inner}) AS result"


def rounded(df: DataFrame, keys: str, values: str = "") -> DataFrame:
    cols = []
    for k in filter(None, (c.strip() for c in keys.split(","))):
        cols.append(F.unix_seconds("ts").alias("ts_s") if k == "ts" else F.col(k))
    for v in filter(None, (c.strip() for c in values.split(","))):
        cols.append((F.round(F.col(v).cast("double") + F.lit(1e-9), 6) + F.lit(0.0)).alias(v))
    return df.select(*cols)


def query(name: str, sql: str | None = None, keys: str = "", values: str = ""):
    """Register ``fn(Tables) -> DataFrame``; with keys/values both sides are shaped alike."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(Tables(spark, folder))
            return rounded(out, keys, values) if keys or values else out

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = rounded_sql(sql, keys, values) if keys or values else sql
        return fn

    return wrap


def load_all() -> None:
    for g in GROUPS:
        importlib.import_module(f"barline.plans.catalog.{g}")
