"""WFO: walk-forward windows, grid search, scores and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.operators import search as sr
from barline.plans import walkforward as wf
from barline.plans.catalog import BARS, W, query
from barline.plans.catalog.aggregates import SCORED, counts_sql, scored
from barline.plans.catalog.joins import GRID
from barline.session import durable
from barline.sources.tables import Tables

ROWS = f"""rw AS (SELECT symbol, row_number() OVER {W} - 1 AS pos, close, volume, coalesce((lead(close) OVER {W} - close) / (lead(close) OVER {W} + close + 1), 0) AS step_return FROM bars),
  wn AS (SELECT symbol, unnest(generate_series(0, (count(*) - 315) // 21)) AS window_id FROM bars GROUP BY symbol HAVING count(*) >= 315)"""
CELLS = f"""{GRID}, gr AS (SELECT * FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY size, level) AS combo, size, level FROM q)), {ROWS},
  cell AS (SELECT rw.symbol, combo, window_id, pos, pos < window_id * 21 + 252 AS training, CASE WHEN close <= level AND volume >= size THEN step_return ELSE 0.0 END AS ret
    FROM rw JOIN gr USING (symbol) JOIN wn ON wn.symbol = rw.symbol AND pos >= window_id * 21 AND pos < window_id * 21 + 315),
  met AS (SELECT symbol, combo, window_id, training, CASE WHEN stddev_pop(ret) > 1e-9 THEN avg(ret) / stddev_pop(ret) * sqrt(252) ELSE 0 END AS sharpe, sum(ret) AS total_return, avg((ret > 0)::INT) AS win_rate FROM cell GROUP BY 1, 2, 3, 4),
  pair_ AS (SELECT a.symbol, a.window_id, a.combo, a.sharpe AS in_sharpe, b.sharpe AS out_sharpe, a.total_return AS in_return, b.total_return AS out_return, a.win_rate AS in_win_rate, b.win_rate AS out_win_rate
    FROM met a JOIN met b USING (symbol, window_id, combo) WHERE a.training AND NOT b.training),
  best AS (SELECT * FROM pair_ JOIN gr USING (symbol, combo) QUALIFY row_number() OVER (PARTITION BY symbol, window_id ORDER BY round(in_sharpe, 9) DESC, combo) = 1),
  cu AS (SELECT c.symbol, c.window_id, pos, sum(ret) OVER (PARTITION BY c.symbol, c.window_id ORDER BY pos) AS cum FROM cell c JOIN best b ON b.symbol = c.symbol AND b.window_id = c.window_id AND b.combo = c.combo WHERE NOT training),
  pk AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY symbol, window_id ORDER BY pos)) AS peak FROM cu), dd AS (SELECT symbol, window_id, max(peak - cum) AS drawdown FROM pk GROUP BY 1, 2),
  sw AS (SELECT *, greatest(0, least(1, 0.5 * CASE WHEN in_sharpe > 0 THEN least(1, out_sharpe / in_sharpe) ELSE 0 END + 0.3 * (1 - abs(in_return - out_return) / greatest(abs(in_return), 0.01)) + 0.2 * (1 - greatest(0, drawdown - 0.2)))) AS validation,
    least(1, list_avg(list_filter([CASE WHEN in_sharpe > 0 THEN greatest(0, (in_sharpe - out_sharpe) / in_sharpe) END, CASE WHEN abs(in_return) > 0 THEN greatest(0, (abs(in_return) - abs(out_return)) / abs(in_return)) END, abs(in_win_rate - out_win_rate)], lambda x: x IS NOT NULL))) AS overfit,
    CASE WHEN out_sharpe > 1 THEN 0.4 WHEN out_sharpe > 0.5 THEN 0.2 ELSE 0 END + CASE WHEN out_return > 0 THEN 0.3 ELSE 0 END + CASE WHEN drawdown < 0.15 THEN 0.3 ELSE 0 END AS significance FROM best JOIN dd USING (symbol, window_id))"""


@query("wfo01_windows",
       f"""WITH {BARS}, {ROWS} SELECT wn.symbol, window_id, CASE WHEN pos < window_id * 21 + 252 THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos
       FROM wn JOIN rw ON rw.symbol = wn.symbol AND pos >= window_id * 21 AND pos < window_id * 21 + 315 GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    rows = wf.rows_with_returns(t.hourly_stored())
    lengths = rows.groupBy("symbol").agg((F.max("pos") + 1).alias("n"))
    tagged = sr.assign_windows(rows, sr.walk_windows(lengths))
    return tagged.groupBy("symbol", "window_id", "role").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query("wfo02_grid_search", f"WITH {BARS}, {CELLS} SELECT * FROM best", "symbol, window_id, combo, size", "level, in_sharpe, out_sharpe, in_return, out_return")
def _(t: Tables) -> DataFrame:
    return wf.best_combos(t.hourly_stored())


for _n, _c in (("wfo03_validation_score", "validation"), ("wfo04_overfit_risk", "overfit"), ("wfo05_significance", "significance")):

    def _register(name: str, column: str) -> None:
        @query(name, f"WITH {BARS}, {CELLS} SELECT * FROM sw", "symbol, window_id", f"drawdown, {column}")
        def _(t: Tables) -> DataFrame:
            return wf.scored_windows(t.hourly_stored())

    _register(_n, _c)


ROLLUP = """ru AS (SELECT symbol, count(*) AS windows, avg(validation) AS mean_validation, stddev_pop(validation) AS sd_validation, avg(overfit) AS mean_overfit, avg((out_sharpe > 0)::INT) AS share_positive,
    CASE WHEN count(*) >= 3 THEN greatest(-1, least(1, coalesce(regr_slope(validation, window_id), 0) * count(*))) ELSE 0 END AS trend FROM sw GROUP BY 1),
  rc AS (SELECT *, CASE WHEN mean_overfit > 0.7 THEN 'HIGH RISK' WHEN mean_overfit > 0.5 THEN 'MEDIUM RISK' ELSE 'LOW RISK' END AS overfit_class, CASE WHEN mean_validation > 0.8 THEN 'EXCELLENT' WHEN mean_validation > 0.6 THEN 'GOOD' ELSE 'POOR' END AS validation_class FROM ru)"""
STATS = """st AS (SELECT symbol, count(*) AS n, avg(out_sharpe) AS sharpe_mean, stddev_pop(out_sharpe) AS sharpe_sd, avg(out_return) AS return_mean, stddev_pop(out_return) AS return_sd, avg((out_sharpe > 0)::INT) AS sharpe_positive,
    avg((out_return > 0)::INT) AS return_positive, avg(out_sharpe) / nullif(stddev_samp(out_sharpe), 0) * sqrt(count(*)) AS t_stat FROM sw GROUP BY 1),
  sk AS (SELECT symbol, avg(pow(out_sharpe - sharpe_mean, 3)) / pow(any_value(sharpe_sd), 3) AS sharpe_skew FROM sw JOIN st USING (symbol) GROUP BY 1),
  th AS (SELECT *, n - 1 AS df, atan(t_stat / sqrt(n - 1)) AS th FROM st),
  pv AS (SELECT symbol, 1 - CASE WHEN df % 2 = 1 THEN 2 / pi() * (abs(th) + CASE WHEN df > 1 THEN sin(abs(th)) * cos(th) * list_sum(list_transform(range(0, (df - 1) // 2), lambda k: CASE WHEN k = 0 THEN 1 ELSE list_product(list_transform(range(1, k + 1), lambda i: 2 * i / (2 * i + 1) * pow(cos(th), 2))) END)) ELSE 0 END)
    ELSE sin(abs(th)) * list_sum(list_transform(range(0, df // 2), lambda k: CASE WHEN k = 0 THEN 1 ELSE list_product(list_transform(range(1, k + 1), lambda i: (2 * i - 1) / (2 * i) * pow(cos(th), 2))) END)) END AS p_value FROM th),
  sv AS (SELECT *, p_value < 0.05 AS significant, CASE WHEN sharpe_mean > 1 AND sharpe_positive > 0.7 THEN 'EXCELLENT' WHEN sharpe_mean > 0.5 AND sharpe_positive > 0.6 THEN 'GOOD' WHEN sharpe_mean > 0 AND sharpe_positive > 0.5 THEN 'FAIR' ELSE 'POOR' END AS rating FROM st JOIN sk USING (symbol) JOIN pv USING (symbol))"""


def _rollup(windows: DataFrame) -> DataFrame:
    return sr.overfit_rollup(windows, ["symbol"])


def _stats(windows: DataFrame) -> DataFrame:
    return sr.statistical_validation(windows, ["symbol"], "out_sharpe", "out_return")


@query("wfo06_overfit_rollup", f"WITH {BARS}, {CELLS}, {ROLLUP} SELECT * FROM rc", "symbol, windows, overfit_class, validation_class", "mean_validation, sd_validation, mean_overfit, share_positive, trend")
def _(t: Tables) -> DataFrame:
    return _rollup(wf.scored_windows(t.hourly_stored()))


@query("wfo07_statistical_validation", f"WITH {BARS}, {CELLS}, {STATS} SELECT * FROM sv", "symbol, n, rating, significant",
       "sharpe_mean, sharpe_sd, sharpe_skew, return_mean, return_sd, sharpe_positive, return_positive, t_stat, p_value")
def _(t: Tables) -> DataFrame:
    return _stats(wf.scored_windows(t.hourly_stored()))


@query("wfo08_recommendation",
       f"""WITH {BARS}, {CELLS}, {ROLLUP}, {STATS}, j AS (SELECT rc.*, rating, sharpe_positive, mean_validation > 0.7 AND mean_overfit < 0.5 AND rating IN ('EXCELLENT', 'GOOD') AS hi, mean_validation > 0.5 AND mean_overfit < 0.7 AND rating IN ('GOOD', 'FAIR') AS md FROM rc JOIN sv USING (symbol))
       SELECT symbol, hi OR md AS use, CASE WHEN hi THEN 'HIGH' WHEN md THEN 'MEDIUM' ELSE 'LOW' END AS confidence, array_to_string(list_filter([CASE WHEN mean_overfit > 0.7 THEN 'high overfitting risk' END, CASE WHEN mean_validation < 0.5 THEN 'poor out-of-sample validation' END,
         CASE WHEN sharpe_positive < 0.5 THEN 'inconsistent across periods' END, CASE WHEN windows < 5 THEN 'too few windows' END, CASE WHEN trend < -0.5 THEN 'declining validation' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM j""",
       "symbol, use, confidence, warnings")
def _(t: Tables) -> DataFrame:
    windows = durable(wf.scored_windows(t.hourly_stored()), "windows")
    return sr.recommendation(_rollup(windows).join(_stats(windows), "symbol"))


@query("wfo09_stable_parameters",
       f"WITH {BARS}, {CELLS}, m AS (SELECT symbol, quantile_cont(validation, 0.5) AS mid FROM sw GROUP BY 1) SELECT symbol, avg(size) AS size, avg(level) AS level, count(*) AS windows FROM sw JOIN m USING (symbol) WHERE validation >= mid GROUP BY 1",
       "symbol, windows", "size, level")
def _(t: Tables) -> DataFrame:
    return sr.stable_parameters(wf.scored_windows(t.hourly_stored()), ["symbol"], ["size", "level"], "validation")


@query("wfo10_window_summary",
       f"WITH {BARS}, {CELLS} SELECT symbol, count(*) AS windows, avg(out_sharpe) AS mean_score, avg(out_return) AS mean_return, arg_max(window_id, (round(out_sharpe, 9), -window_id)) AS best_window, arg_min(window_id, (round(out_sharpe, 9), window_id)) AS worst_window FROM best GROUP BY 1",
       "symbol, windows, best_window, worst_window", "mean_score, mean_return")
def _(t: Tables) -> DataFrame:
    return sr.window_summary(wf.best_combos(t.hourly_stored()), ["symbol"], "out_sharpe")


for _n, _s, _hi in (("wfo11_threshold_f05", "f05", 0.95), ("wfo11_threshold_f1", "f1", 0.9)):

    def _thresholds(name: str, score: str, high: float) -> None:
        @query(name, f"WITH {counts_sql(0.3, high, 50)} SELECT threshold, trades, precision, recall, {score} FROM counts WHERE trades >= 10 ORDER BY round({score}, 12) DESC, threshold LIMIT 1",
               "trades", f"threshold, precision, recall, {score}")
        def _(t: Tables) -> DataFrame:
            return sr.search_thresholds(scored(t), score, 0.3, high)

    _thresholds(_n, _s, _hi)


PROFIT = f"""{SCORED}, t AS (SELECT 0.3::DOUBLE + 0.65::DOUBLE * i / 49 AS threshold FROM range(50) x(i)), nt AS (SELECT threshold, score >= threshold AS hit, CASE WHEN score >= threshold THEN ret - abs(ret) * 0.002 ELSE 0 END AS net FROM scored, t),
  pf AS (SELECT threshold, count(*) FILTER (hit) AS trades, sum(net) AS net_return, avg(net) / (stddev_pop(net) + 1e-9) * sqrt(6048) AS sharpe, coalesce(avg(net) FILTER (hit), 0) AS avg_return, coalesce(avg((net > 0)::INT) FILTER (hit), 0) AS win_rate FROM nt GROUP BY 1)"""


@query("wfo12_profit_by_threshold", f"WITH {PROFIT} SELECT * FROM pf", "trades", "threshold, net_return, sharpe, avg_return, win_rate")
def _(t: Tables) -> DataFrame:
    return sr.search_by_profit(scored(t))


@query("wfo12_best_profit", f"WITH {PROFIT} SELECT * FROM pf WHERE trades >= 10 ORDER BY round(net_return, 12) DESC, threshold LIMIT 1", "trades", "threshold, net_return, sharpe, avg_return, win_rate")
def _(t: Tables) -> DataFrame:
    return sr.search_by_profit(scored(t)).filter("trades >= 10").orderBy(F.desc("net_return"), "threshold").limit(1)


def _subsamples(t: Tables) -> DataFrame:
    d = t.events.select("event_id", "event_type", ((F.col("value") - 50) / 1000).alias("r"))
    d = sr.hash_fractions(d, "event_id", [0.5, 0.75, 0.9])
    return d.groupBy("event_type", "fraction").agg(
        F.count("*").alias("n"), F.avg("r").alias("mean_return"), (F.avg("r") / (F.stddev_pop("r") + 1e-9)).alias("sharpe"))


# The sample key is the md5 of "42:<id>", read as an integer: any engine can repeat it.
SUBS = """h AS (SELECT event_type, (value - 50) / 1000 AS r, ('0x' || substr(md5('42:' || event_id), 1, 8))::BIGINT % 10000 / 10000 AS u FROM events), f AS (SELECT unnest([0.5, 0.75, 0.9]) AS fraction),
  sb AS (SELECT event_type, fraction, count(*) AS n, avg(r) AS mean_return, avg(r) / (stddev_pop(r) + 1e-9) AS sharpe FROM h JOIN f ON u < fraction GROUP BY 1, 2)"""


@query("wfo13_subsamples", f"WITH {SUBS} SELECT * FROM sb", "event_type, n", "fraction, mean_return, sharpe")
def _(t: Tables) -> DataFrame:
    return _subsamples(t)


@query("wfo14_robustness",
       f"WITH {SUBS} SELECT event_type, (least(1, 1.5 * avg((mean_return > 0)::INT)) + (1 - stddev_pop(sharpe) / greatest(avg(sharpe), 0.1))) / 2 AS robustness FROM sb GROUP BY 1", "event_type", "robustness")
def _(t: Tables) -> DataFrame:
    d = _subsamples(t).groupBy("event_type").agg(
        F.avg((F.col("mean_return") > 0).cast("int")).alias("p"), F.stddev_pop("sharpe").alias("sd"), F.avg("sharpe").alias("m"))
    return d.withColumn("robustness", sr.robustness(F.col("p"), F.col("sd"), F.col("m")))
