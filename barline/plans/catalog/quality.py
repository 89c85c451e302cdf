"""DQ: rules, outliers, imputation, scores and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.functions import windows as w
from barline.operators import quality as dq
from barline.operators.onerow import with_row
from barline.plans.catalog import BARS, W, query
from barline.sources.tables import Tables


@query("dq01_validate_bars",
       f"""WITH {BARS}, b AS (SELECT symbol, ts, open, high, low, CASE WHEN volume >= 5 THEN high + 1 WHEN volume >= 4 THEN NULL ELSE close END AS close FROM bars),
       c AS (SELECT count(*) FILTER (least(open, high, low, close) < 0) AS negative_prices, count(*) FILTER (high < low) AS high_below_low, count(*) FILTER (close < low OR close > high) AS close_outside, count(*) FILTER (close IS NULL) AS null_keys FROM b)
       SELECT *, CASE WHEN negative_prices > 0 THEN 'negative_prices' WHEN high_below_low > 0 THEN 'high_below_low' WHEN close_outside > 0 THEN 'close_outside' WHEN null_keys > 0 THEN 'null_keys' ELSE 'valid' END AS first_failure FROM c""",
       "negative_prices, high_below_low, close_outside, null_keys, first_failure")
def _(t: Tables) -> DataFrame:
    v = F.col("volume")
    damaged = F.when(v >= 5, F.col("high") + 1).when(v >= 4, None).otherwise(F.col("close"))
    return dq.validate_bars(t.hourly().withColumn("close", damaged))


IQR = """f AS (SELECT l_returnflag AS k, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS med, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem GROUP BY 1),
  g AS (SELECT k, med, a - 0.5 * (b - a) AS lo, b + 0.5 * (b - a) AS hi FROM f), x AS (SELECT * FROM lineitem JOIN g ON k = l_returnflag)"""
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = ", ".join(LINE)


@query("dq02_iqr_outliers", f"WITH {IQR} SELECT {KEYS}, l_extendedprice < lo OR l_extendedprice > hi AS outlier FROM x")
def _(t: Tables) -> DataFrame:
    d = t.lineitem.select(*LINE, "l_returnflag", "l_extendedprice")
    return dq.flag_iqr(d, "l_extendedprice", ["l_returnflag"], k=0.5).select(*LINE, "outlier")


@query("dq03_z_outliers",
       f"""WITH s AS (SELECT l_returnflag AS k, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY 1)
       SELECT {KEYS}, coalesce(abs((l_extendedprice - m) / nullif(sd, 0)) > 1.5, false) AS outlier FROM lineitem JOIN s ON k = l_returnflag""")
def _(t: Tables) -> DataFrame:
    d = t.lineitem.select(*LINE, "l_returnflag", "l_extendedprice")
    return dq.flag_zscore(d, "l_extendedprice", ["l_returnflag"], 1.5).select(*LINE, "outlier")


@query("dq04_modified_z",
       """WITH m AS (SELECT median(n_chars) AS med FROM documents), a AS (SELECT median(abs(n_chars - med)) AS mad FROM documents, m)
       SELECT doc_id, coalesce(abs(0.6745 * (n_chars - med) / nullif(mad, 0)) > 3.5, false) AS outlier FROM documents, m, a""")
def _(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    return dq.flag_modified_z(d, "n_chars", []).select("doc_id", "outlier")


@query("dq05_outlier_treatment",
       """WITH q AS (SELECT event_type AS k, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1),
       f AS (SELECT k, med, a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q)
       SELECT event_id, greatest(lo, least(hi, value)) AS clipped, CASE WHEN value BETWEEN lo AND hi THEN value END AS nulled, CASE WHEN value BETWEEN lo AND hi THEN value ELSE med END AS medianed FROM events JOIN f ON k = event_type""",
       "event_id", "clipped, nulled, medianed")
def _(t: Tables) -> DataFrame:
    d = t.events.select("event_id", "event_type", "value")
    fences = dq.iqr_fences(d, "value", ["event_type"])
    x, lo, hi = F.col("value"), F.col("low_fence"), F.col("high_fence")
    inside = x.between(lo, hi)
    return dq.attach(d, fences, ["event_type"]).select(
        "event_id", F.least(F.greatest(x, lo), hi).alias("clipped"), F.when(inside, x).alias("nulled"), F.when(inside, x).otherwise(F.col("median")).alias("medianed"))


HOLES = "CASE WHEN volume >= 3 THEN close END"


@query("dq06_imputation",
       f"""WITH {BARS}, h AS (SELECT symbol, ts, {HOLES} AS x FROM bars), s AS (SELECT symbol, avg(x) AS m, quantile_cont(x, 0.5) AS med FROM h GROUP BY 1)
       SELECT symbol, ts, coalesce(x, m) AS by_mean, coalesce(x, med) AS by_median, coalesce(x, 0) AS by_zero, last_value(x IGNORE NULLS) OVER {W} AS by_ffill FROM h JOIN s USING (symbol)""",
       "symbol, ts", "by_mean, by_median, by_zero, by_ffill")
def _(t: Tables) -> DataFrame:
    d = t.hourly_stored().withColumn("x", F.expr(HOLES)).select("symbol", "ts", *[F.col("x").alias(f"by_{k}") for k in ("mean", "median", "zero", "ffill")])
    for how in ("mean", "median", "zero", "ffill"):
        d = dq.impute(d, f"by_{how}", how, ["symbol"], bounded=True)
    return d


@query("dq07_acceptable_missing",
       f"""WITH {BARS}, f AS (SELECT close / nullif(lag(close, 24) OVER {W}, 0) - 1 AS ret24, {HOLES} AS busy FROM bars), m AS (SELECT 'ret24' AS "column", avg((ret24 IS NULL)::INT) AS missing FROM f UNION ALL SELECT 'busy', avg((busy IS NULL)::INT) FROM f)
       SELECT "column" AS feature, missing, missing <= 0.1 AS acceptable FROM m""", "feature, acceptable", "missing")
def _(t: Tables) -> DataFrame:
    d = t.hourly().withColumns({"ret24": w.change("close", 24), "busy": F.expr(HOLES)})
    return dq.acceptable_missing(d, ["ret24", "busy"]).withColumnRenamed("column", "feature")


AS_OF = "2024-01-31 00:00:00"


@query("dq08_freshness",
       f"SELECT user_id, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts))) / 3600000000 AS age_hours, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts))) / 3600000000 <= 24 AS fresh FROM events GROUP BY 1",
       "user_id, fresh", "age_hours")
def _(t: Tables) -> DataFrame:
    return dq.freshness(t.events, F.lit(AS_OF).cast("timestamp"), keys=["user_id"])


RANGES = {"open": (0.0, 100.0), "close": (5.0, 60.0), "volume": (1.0, 4.0)}


@query("dq09_ranges",
       f"WITH {BARS} " + " UNION ALL ".join(
           f"SELECT '{k}' AS feature, count(*) FILTER ({k} < {lo} OR {k} > {hi}) AS out_of_range, avg(({k} < {lo} OR {k} > {hi})::INT) AS share, min({k}) AS lowest, max({k}) AS highest FROM bars"
           for k, (lo, hi) in RANGES.items()), "feature, out_of_range", "share, lowest, highest")
def _(t: Tables) -> DataFrame:
    return dq.validate_ranges(t.hourly(), RANGES).withColumnRenamed("column", "feature")


def score_sql(source: str, out: str) -> str:
    cols = ["open", "close", "volume"]
    z = " + ".join(f"avg(coalesce(abs(({c} - m_{c}) / nullif(sd_{c}, 0)) > 3, false)::INT)" for c in cols)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS sd_{c}" for c in cols)
    return f"""{out}_s AS (SELECT {stats} FROM {source}), {out}_c AS (SELECT 1 - ({' + '.join(f'avg(({c} IS NULL)::INT)' for c in cols)}) / 3 AS completeness,
      ({' + '.join(f'avg(coalesce({c} BETWEEN {RANGES[c][0]} AND {RANGES[c][1]}, true)::INT)' for c in cols)}) / 3 AS validity,
      greatest(0, 1 - (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts))) / 3600000000 / 24) AS freshness, 1 - ({z}) / 3 AS consistency FROM {source}, {out}_s),
      {out} AS (SELECT *, 0.3 * completeness + 0.25 * validity + 0.25 * freshness + 0.2 * consistency AS score FROM {out}_c)"""


HOLED = f"hb AS (SELECT symbol, ts, open, volume, {HOLES} AS close FROM bars)"
COLS = ["open", "close", "volume"]


def _holed(t: Tables) -> DataFrame:
    return t.hourly_stored().select("symbol", "ts", "open", "volume", F.expr(HOLES).alias("close"))


@query("dq10_quality_score", f"WITH {BARS}, {HOLED}, {score_sql('hb', 'sc')} SELECT *, score >= 0.7 AS passed FROM sc", "passed", "completeness, validity, freshness, consistency, score")
def _(t: Tables) -> DataFrame:
    return dq.quality_score(_holed(t), COLS, F.lit(AS_OF).cast("timestamp"), RANGES)


def _clean_sql() -> str:
    fences = ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in COLS)
    keep = ", ".join(f"CASE WHEN h.{c} IS NOT NULL THEN greatest(a_{c} - 1.5 * (b_{c} - a_{c}), least(b_{c} + 1.5 * (b_{c} - a_{c}), h.{c})) END AS {c}" for c in COLS)
    fill = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER {W}, first_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}" for c in COLS)
    return f"fe AS (SELECT symbol, {fences} FROM hb GROUP BY 1), cl AS (SELECT h.symbol, h.ts, {keep} FROM hb h JOIN fe USING (symbol)), cf AS (SELECT symbol, ts, {fill} FROM cl)"


@query("dq11_clean", f"WITH {BARS}, {HOLED}, {_clean_sql()} SELECT * FROM cf", "symbol, ts", "open, close, volume")
def _(t: Tables) -> DataFrame:
    return dq.clean(_holed(t), COLS, ["symbol"])


@query("dq11_clean_report",
       f"WITH {BARS}, {HOLED}, {_clean_sql()}, {score_sql('hb', 'sa')}, {score_sql('cf', 'sb')} SELECT sa.score AS before, sb.score AS after, sb.score - sa.score AS improvement FROM sa, sb", "", "before, after, improvement")
def _(t: Tables) -> DataFrame:
    at = F.lit(AS_OF).cast("timestamp")
    raw = _holed(t)
    before = dq.quality_score(raw, COLS, at, RANGES).select(F.col("score").alias("before"))
    after = dq.quality_score(dq.clean(raw, COLS, ["symbol"]), COLS, at, RANGES).select(F.col("score").alias("after"))
    return with_row(before, after).withColumn("improvement", F.col("after") - F.col("before"))


@query("dq12_source_report",
       f"""WITH {BARS}, g AS (SELECT symbol, ts, open, {HOLES} AS close, (epoch_us(ts) - epoch_us(lag(ts) OVER {W})) / 60000000 AS gap FROM bars), m AS (SELECT symbol, quantile_cont(gap, 0.5) AS mid FROM g GROUP BY 1),
       r AS (SELECT symbol, count(*) AS n_rows, (avg((open IS NULL)::INT) + avg((close IS NULL)::INT)) / 2 AS missing, epoch(min(ts))::BIGINT AS first_s, epoch(max(ts))::BIGINT AS last_s, count(*) FILTER (gap > 3 * mid) AS gaps FROM g JOIN m USING (symbol) GROUP BY 1)
       SELECT *, greatest(0, 1 - 2 * missing - least(0.2, gaps / 100) - CASE WHEN n_rows < 1000 THEN 0.2 WHEN n_rows < 5000 THEN 0.1 ELSE 0 END) AS score FROM r""",
       "symbol, n_rows, first_s, last_s, gaps", "missing, score")
def _(t: Tables) -> DataFrame:
    d = dq.source_report(t.hourly().withColumn("close", F.expr(HOLES)), ["open", "close"], w.gap_minutes(), ["symbol"])
    return d.withColumns({"first_s": F.unix_seconds("first_ts"), "last_s": F.unix_seconds("last_ts")})


@query("dq13_drift",
       """WITH a AS (SELECT event_type, avg(value) AS mc, count(*) AS nc FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1), b AS (SELECT event_type, avg(value) AS mr, stddev_pop(value) AS sr, count(*) AS nr FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1)
       SELECT event_type, CASE WHEN nc >= 30 AND nr >= 30 AND sr > 0 THEN abs(mc - mr) / sr ELSE 0 END AS drift FROM a JOIN b USING (event_type)""", "event_type", "drift")
def _(t: Tables) -> DataFrame:
    e = t.events
    return dq.drift(e.filter("ts >= timestamp'2024-01-16'"), e.filter("ts < timestamp'2024-01-16'"), "value", ["event_type"])
