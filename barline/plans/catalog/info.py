"""INF: states, entropies and the phi family; SIG-16/17 build on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.functions import signals as sg, windows as w
from barline.operators import info
from barline.plans.catalog import BARS, W, query
from barline.sources.tables import Tables

RET = f"r AS (SELECT symbol, ts, volume, ret FROM (SELECT symbol, ts, volume, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret FROM bars) WHERE ret IS NOT NULL)"


def _returns(t: Tables) -> DataFrame:
    return t.hourly_stored().withColumn("ret", w.change("close")).dropna(subset=["ret"]).select("symbol", "ts", "volume", "ret")


def edges(x: str, source: str, out: str) -> str:
    """Inner distinct quartile edges of x per symbol as a list."""
    return f"""{out} AS (SELECT symbol, list_sort(list_distinct([quantile_cont({x}, 0), quantile_cont({x}, 0.25), quantile_cont({x}, 0.5), quantile_cont({x}, 0.75), quantile_cont({x}, 1.0)])) AS e FROM {source} GROUP BY 1)"""


def state(x: str, e: str = "e") -> str:
    return f"least(3, len(list_filter({e}[2:len({e}) - 1], lambda b: b <= {x})))"


STATES = f"{RET}, {edges('ret', 'r', 'er')}, {edges('volume::DOUBLE', 'r', 'ev')}, s AS (SELECT r.symbol, r.ts, {state('ret', 'er.e')} AS sr, {state('volume', 'ev.e')} AS sv FROM r JOIN er USING (symbol) JOIN ev USING (symbol))"


def _states(t: Tables) -> DataFrame:
    d = info.with_states(_returns(t), "ret", ["symbol"], "sr", bounded=True)
    return info.with_states(d, "volume", ["symbol"], "sv", bounded=True)


@query("inf01_discretise",
       f"""WITH {BARS}, {STATES}, u AS (SELECT symbol, min(volume) AS lo, max(volume) AS hi FROM r GROUP BY 1)
       SELECT s.symbol, s.ts, sr::BIGINT AS sr, sv::BIGINT AS sv, least(3, (volume >= lo + (hi - lo) * 0.25)::INT + (volume >= lo + (hi - lo) * 0.5)::INT + (volume >= lo + (hi - lo) * 0.75)::INT)::BIGINT AS su FROM s JOIN r ON r.symbol = s.symbol AND r.ts = s.ts JOIN u ON u.symbol = s.symbol""",
       "symbol, ts, sr, sv, su")
def _(t: Tables) -> DataFrame:
    return info.with_states(_states(t), "volume", ["symbol"], "su", how="uniform", bounded=True)


@query("inf02_transitions",
       f"""WITH {BARS}, {STATES}, n AS (SELECT symbol, sr AS state, lead(sr) OVER {W} AS next_state FROM s), c AS (SELECT symbol, state::BIGINT AS state, next_state::BIGINT AS next_state, count(*) AS n FROM n WHERE next_state IS NOT NULL GROUP BY 1, 2, 3)
       SELECT *, n / sum(n) OVER (PARTITION BY symbol, state) AS share FROM c""", "symbol, state, next_state, n", "share")
def _(t: Tables) -> DataFrame:
    return info.transition_matrix(_states(t), ["symbol"], "sr")


def _entropy(cols: str, out: str) -> str:
    return f"{out} AS (SELECT symbol, -sum(p * log2(p)) AS h FROM (SELECT symbol, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS p FROM s GROUP BY symbol, {cols}) GROUP BY 1)"


@query("inf03_entropy", f"WITH {BARS}, {STATES}, {_entropy('sr', 'h')} SELECT symbol, h AS entropy FROM h", "symbol", "entropy")
def _(t: Tables) -> DataFrame:
    return info.entropy(_states(t), ["symbol"], ["sr"])


@query("inf04_mutual_information",
       f"WITH {BARS}, {STATES}, {_entropy('sr', 'a')}, {_entropy('sv', 'b')}, {_entropy('sr, sv', 'c')} SELECT symbol, greatest(0, a.h + b.h - c.h) AS mutual_information FROM a JOIN b USING (symbol) JOIN c USING (symbol)",
       "symbol", "mutual_information")
def _(t: Tables) -> DataFrame:
    return info.mutual_information(_states(t), ["symbol"], "sr", "sv")


@query("inf05_transfer_entropy",
       f"""WITH {BARS}, {STATES}, l AS (SELECT symbol, sr AS y, lag(sr) OVER {W} AS yp, lag(sv) OVER {W} AS xp FROM s), k AS (SELECT * FROM l WHERE yp IS NOT NULL),
       j AS (SELECT symbol, count(*) AS n FROM k GROUP BY 1),
       a AS (SELECT symbol, -sum(c * log2(c / p)) AS h FROM (SELECT symbol, count(*) AS c, sum(count(*)) OVER (PARTITION BY symbol, yp) AS p FROM k GROUP BY symbol, yp, y) GROUP BY 1),
       b AS (SELECT symbol, -sum(c * log2(c / p)) AS h FROM (SELECT symbol, count(*) AS c, sum(count(*)) OVER (PARTITION BY symbol, yp, xp) AS p FROM k GROUP BY symbol, yp, xp, y) GROUP BY 1)
       SELECT symbol, greatest(0, (a.h - b.h) / n) AS transfer_entropy FROM a JOIN b USING (symbol) JOIN j USING (symbol)""",
       "symbol", "transfer_entropy")
def _(t: Tables) -> DataFrame:
    return info.transfer_entropy(_states(t), ["symbol"], "sv", "sr")


# Phi per window of bars; g is the window id.
def phi_sql(rows: str, group: str) -> str:
    """CTEs from ``rows`` (g, ts, ret[, vret]) to per-window measures."""
    e = edges("ret", rows, "pe").replace("symbol", "g")
    ac = ", ".join(f"abs(corr(ret, l{k})) AS c{k}" for k in range(1, 10))
    lags = ", ".join(f"lead(ret, {k}) OVER (PARTITION BY g ORDER BY ts) AS l{k}" for k in range(1, 10))
    return f"""{e}, ps AS (SELECT x.g, x.ts, {state('ret')} AS s FROM {rows} x JOIN pe ON pe.g = x.g),
      pn AS (SELECT *, lead(s) OVER (PARTITION BY g ORDER BY ts) AS nx, count(*) OVER (PARTITION BY g) AS n, count(*) OVER (PARTITION BY g, s) AS ns FROM ps),
      ph AS (SELECT g, -sum(p * log2(p)) AS h FROM (SELECT g, count(*) / any_value(n) AS p FROM pn GROUP BY g, s) GROUP BY 1),
      pt AS (SELECT g, s, -sum(c / t * log2(c / t)) AS hs FROM (SELECT g, s, count(*) AS c, sum(count(*)) OVER (PARTITION BY g, s) AS t FROM pn WHERE nx IS NOT NULL GROUP BY g, s, nx) GROUP BY 1, 2),
      pc AS (SELECT g, sum(w * coalesce(hs, 0)) AS hc FROM (SELECT g, s, any_value(ns) / any_value(n) AS w FROM pn GROUP BY 1, 2) q LEFT JOIN pt USING (g, s) GROUP BY 1),
      al AS (SELECT g, ret, {lags} FROM {rows}), aa AS (SELECT g, {ac} FROM al GROUP BY 1),
      ab AS (SELECT g, list_avg(l) AS m, list_stddev_pop(l) AS sd FROM (SELECT g, [c1, c2, c3, c4, c5, c6, c7, c8, c9] AS l FROM aa)),
      {group} AS (SELECT g, h AS raw_entropy, greatest(0, least(1, (h - hc) / 2)) AS phi_uni, 4 * h / 2 * (1 - h / 2) AS phi_entropy, greatest(0, least(1, m * (1 + sd / (m + 1e-10)) * 2)) AS phi_complexity
        FROM ph JOIN pc USING (g) JOIN ab USING (g))"""


# Every bar that ends a window of 100 bars is a window; its id is the symbol and the time of that bar.
TAIL = f"""tb AS (SELECT *, row_number() OVER {W} AS i FROM bars),
  t100 AS (SELECT e.symbol || '|' || epoch_us(e.ts)::VARCHAR AS g, x.ts, x.close, x.volume FROM tb e JOIN tb x ON x.symbol = e.symbol AND x.i BETWEEN e.i - 99 AND e.i WHERE e.i >= 100),
  tr AS (SELECT g, ts, close / lag(close) OVER tw - 1 AS ret, volume / lag(volume) OVER tw - 1 AS vret FROM t100 WINDOW tw AS (PARTITION BY g ORDER BY ts)), rr AS (SELECT * FROM tr WHERE ret IS NOT NULL)"""


def window_id(g: str = "g") -> str:
    return f"split_part({g}, '|', 1) AS symbol, make_timestamp(split_part({g}, '|', 2)::BIGINT) AS ts"


def _tail(t: Tables) -> DataFrame:
    d = info.trailing_arrays(t.hourly(), {"closes": "close", "volumes": "volume"}, 100)
    return d.withColumn("r", F.expr(info.changes("closes"))).withColumn("v", F.expr(info.changes("volumes")))


@query("inf06_phi", f"WITH {BARS}, {TAIL}, {phi_sql('rr', 'phi')} SELECT {window_id()}, raw_entropy, phi_uni AS phi_iit, phi_entropy, phi_complexity, (phi_uni + phi_entropy + phi_complexity) / 3 AS phi FROM phi",
       "symbol, ts", "raw_entropy, phi_iit, phi_entropy, phi_complexity, phi")
def _(t: Tables) -> DataFrame:
    return info.phi_columns(_tail(t), "r")


@query("inf06_phi_bivariate",
       f"""WITH {BARS}, {TAIL}, {phi_sql('rr', 'pa')}, vv AS (SELECT g, ts, vret AS ret FROM rr), {phi_sql('vv', 'pb').replace('pe AS', 'pe2 AS').replace('JOIN pe ON pe.g', 'JOIN pe2 ON pe2.g').replace('ps AS', 'ps2 AS').replace('FROM ps)', 'FROM ps2)').replace('pn AS', 'pn2 AS').replace('FROM pn', 'FROM pn2').replace('ph AS', 'ph2 AS').replace('FROM ph ', 'FROM ph2 ').replace('pt AS', 'pt2 AS').replace('JOIN pt ', 'JOIN pt2 ').replace('pc AS', 'pc2 AS').replace('JOIN pc ', 'JOIN pc2 ').replace('al AS', 'al2 AS').replace('FROM al ', 'FROM al2 ').replace('aa AS', 'aa2 AS').replace('FROM aa)', 'FROM aa2)').replace('ab AS', 'ab2 AS').replace('JOIN ab ', 'JOIN ab2 ')},
       jj AS (SELECT g, -sum(p * log2(p)) AS h FROM (SELECT a.g, count(*) / sum(count(*)) OVER (PARTITION BY a.g) AS p FROM ps a JOIN ps2 b ON a.g = b.g AND a.ts = b.ts GROUP BY a.g, a.s, b.s) GROUP BY 1)
       SELECT {window_id('pa.g')}, greatest(0, least(1, (greatest(0, pa.raw_entropy + pb.raw_entropy - jj.h) / 2 + pa.phi_uni + pb.phi_uni) / 3)) AS phi_iit FROM pa JOIN pb USING (g) JOIN jj USING (g)""",
       "symbol, ts", "phi_iit")
def _(t: Tables) -> DataFrame:
    return info.phi_columns(_tail(t), "r", "v")


REGIME = f"""z AS (SELECT g, avg(ret) AS m, stddev_pop(ret) AS sd, quantile_cont(abs(ret), 0.75) AS p75, count(*) AS n FROM rr GROUP BY 1),
  x AS (SELECT {window_id()}, raw_entropy, phi_uni AS phi_iit, phi_entropy, phi_complexity, (phi_uni + phi_entropy + phi_complexity) / 3 AS phi, m, sd, p75, n FROM phi JOIN z USING (g)),
  y AS (SELECT *, CASE WHEN phi > 0.7 AND m > 0 THEN 'trending_up' WHEN phi > 0.7 AND m < 0 THEN 'trending_down' WHEN phi > 0.7 THEN 'integrated_neutral' WHEN phi > 0.4 THEN 'complex' WHEN sd > p75 THEN 'chaotic' ELSE 'random' END AS regime,
    (least(1, n / 100) + 1 - 2 * abs(phi - 0.5)) / 2 AS confidence FROM x)"""


@query("inf07_regime", f"WITH {BARS}, {TAIL}, {phi_sql('rr', 'phi')}, {REGIME} SELECT * FROM y", "symbol, ts, regime", "phi, confidence")
def _(t: Tables) -> DataFrame:
    return info.regime_columns(info.phi_columns(_tail(t), "r"), "r")


@query("inf08_proxy", f"WITH {BARS}, {TAIL}, {phi_sql('rr', 'phi')}, {REGIME} SELECT * FROM y", "symbol, ts, regime",
       "phi_iit, phi_entropy, phi_complexity, phi, raw_entropy, confidence")
def _(t: Tables) -> DataFrame:
    d = info.proxy_record(info.regime_columns(info.phi_columns(_tail(t), "r"), "r"))
    return d.select("symbol", "ts", "proxy.*")


WEEK = "wk AS (SELECT symbol, date_trunc('week', ts) AS ts, list(close ORDER BY bars.ts) AS r FROM bars GROUP BY 1, 2)"


def _weeks(t: Tables) -> DataFrame:
    """Hourly closes per symbol and calendar week: at most 168 values per array."""
    week = F.date_trunc("week", "ts").alias("week")
    rows = F.array_sort(F.collect_list(F.struct("ts", "close")))
    d = t.hourly().groupBy("symbol", week).agg(rows.alias("_rows"))
    return d.select("symbol", F.col("week").alias("ts"), F.transform("_rows", lambda s: s["close"]).alias("r"))


@query("inf09_lempel_ziv",
       f"""WITH RECURSIVE {BARS}, {WEEK}, b AS (SELECT symbol, ts, len(r) AS n, array_to_string(list_transform(r, lambda x: CASE WHEN x > list_median(r) THEN '1' ELSE '0' END), '') AS s FROM wk),
       f(symbol, ts, n, s, i, e, c) AS (SELECT symbol, ts, n, s, 0, 1, 1 FROM b
         UNION ALL SELECT symbol, ts, n, s, CASE WHEN i > 0 AND contains(substr(s, 1, i), substr(s, i + 1, e - i)) THEN i ELSE e END, e + 1,
           CASE WHEN i > 0 AND contains(substr(s, 1, i), substr(s, i + 1, e - i)) THEN c ELSE c + 1 END FROM f WHERE e <= n)
       SELECT symbol, ts, CASE WHEN n > 1 THEN least(1, c / (n / log2(n))) ELSE 0.5 END AS complexity FROM f WHERE e = n + 1""",
       "symbol, ts", "complexity")
def _(t: Tables) -> DataFrame:
    return _weeks(t).withColumn("complexity", F.expr(info.lempel_ziv("r")))


@query("inf10_sample_entropy",
       f"""WITH {BARS}, p AS (SELECT symbol, date_trunc('week', ts) AS wk, close AS x0, lead(close) OVER v AS x1, lead(close, 2) OVER v AS x2, row_number() OVER v AS i FROM bars WINDOW v AS (PARTITION BY symbol, date_trunc('week', ts) ORDER BY ts)),
       z AS (SELECT symbol, wk, 0.2 * stddev_pop(x0) AS tol FROM p GROUP BY 1, 2),
       m AS (SELECT a.symbol, a.wk, count(*) FILTER (b.x1 IS NOT NULL AND b.x2 IS NOT NULL AND abs(a.x1 - b.x1) < tol) AS a2, count(*) FILTER (b.x2 IS NOT NULL AND b.has3 AND abs(a.x1 - b.x1) < tol AND abs(a.x2 - b.x2) < tol) AS b2
         FROM (SELECT *, lead(i, 3) OVER (PARTITION BY symbol, wk ORDER BY i) IS NOT NULL AS has3 FROM p) a JOIN (SELECT *, lead(i, 3) OVER (PARTITION BY symbol, wk ORDER BY i) IS NOT NULL AS has3 FROM p) b
         ON a.symbol = b.symbol AND a.wk = b.wk AND a.i < b.i JOIN z ON z.symbol = a.symbol AND z.wk = a.wk WHERE abs(a.x0 - b.x0) < tol GROUP BY 1, 2)
       SELECT z.symbol, z.wk AS ts, CASE WHEN tol < 1e-10 OR coalesce(a2, 0) = 0 OR coalesce(b2, 0) = 0 THEN 0.5 ELSE greatest(0, least(1, 1 - b2 / a2)) END AS sample_entropy FROM z LEFT JOIN m ON m.symbol = z.symbol AND m.wk = z.wk""",
       "symbol, ts", "sample_entropy")
def _(t: Tables) -> DataFrame:
    return info.sample_entropy(_weeks(t), "r", "sample_entropy")


@query("inf11_autocorrelation",
       f"""WITH {BARS}, {WEEK}, c AS (SELECT symbol, ts, len(r) AS n, list_transform(r, lambda x: x - list_avg(r)) AS c, list_var_pop(r) AS v FROM wk),
       k AS (SELECT *, unnest(generate_series(1, greatest(1, least(20, n // 3) - 1))) AS k FROM c WHERE n >= 20 AND v >= 1e-10),
       a AS (SELECT symbol, ts, k, abs(list_inner_product(c[1:n - k], c[k + 1:n]) / ((n - k) * v)) AS ac FROM k), g AS (SELECT symbol, ts, count(*) AS lags, avg(ac) AS m, stddev_pop(ac) AS sd FROM a GROUP BY 1, 2)
       SELECT c.symbol, c.ts, CASE WHEN n < 20 THEN 0.5 WHEN v < 1e-10 THEN 0 WHEN coalesce(lags, 0) < 2 THEN 0.5 ELSE greatest(0, least(1, (m + sd) / 2 * 3)) END AS complexity FROM c LEFT JOIN g USING (symbol, ts)""",
       "symbol, ts", "complexity")
def _(t: Tables) -> DataFrame:
    return info.autocorrelation_complexity(_weeks(t), "r", "complexity")


ROLL = f"""nb AS (SELECT symbol, ts, close, row_number() OVER {W} AS rn FROM bars),
  wr AS (SELECT b.symbol || ':' || b.rn AS g, p.ts, p.close / nullif(lag(p.close) OVER (PARTITION BY b.symbol, b.rn ORDER BY p.ts), 0) - 1 AS ret FROM nb b JOIN nb p ON p.symbol = b.symbol AND p.rn BETWEEN b.rn - 100 AND b.rn - 1 WHERE b.rn > 100),
  rr AS (SELECT * FROM wr WHERE ret IS NOT NULL)"""
FILTER = f"""fb AS (SELECT symbol, ts, rn, close, coalesce((phi_uni + phi_entropy + phi_complexity) / 3, 0.5) AS phi, close / nullif(lag(close) OVER {W}, 0) - 1 AS d FROM nb LEFT JOIN phi ON phi.g = symbol || ':' || rn),
  fs AS (SELECT *, CASE WHEN d > 0.02 THEN 1 ELSE 0 END AS sig, coalesce(lead(close) OVER {W} / nullif(close, 0) - 1, 0) AS fret FROM fb),
  ff AS (SELECT *, sig * (sum((phi > 0.25)::INT) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) >= 5)::INT AS filtered FROM fs)"""


def _filtered(t: Tables) -> DataFrame:
    d = info.rolling_phi(t.hourly()).withColumn("sig", F.when(sg.threshold_move("close", 0.02) > 0, 1).otherwise(0))
    return info.phi_filter(d, "sig", 0.25).withColumn("fret", F.coalesce(w.next_change(), F.lit(0.0)))


@query("sig16_phi_filter", f"WITH {BARS}, {ROLL}, {phi_sql('rr', 'phi')}, {FILTER} SELECT symbol, ts, sig, filtered, phi FROM ff", "symbol, ts, sig, filtered", "phi")
def _(t: Tables) -> DataFrame:
    return _filtered(t)


@query("sig17_filter_statistics",
       f"""WITH {BARS}, {ROLL}, {phi_sql('rr', 'phi')}, {FILTER} SELECT symbol, sum(sig)::BIGINT AS trades_before, sum(filtered)::BIGINT AS trades_after, 1 - sum(filtered) / sum(sig) AS filter_rate, avg(phi) AS mean_phi, avg((phi > 0.25)::INT) AS share_above,
       avg(fret * sig) / (stddev_pop(fret * sig) + 1e-9) * sqrt(6048) AS sharpe_before, avg(fret * filtered) / (stddev_pop(fret * filtered) + 1e-9) * sqrt(6048) AS sharpe_after,
       avg(fret * filtered) / (stddev_pop(fret * filtered) + 1e-9) * sqrt(6048) - avg(fret * sig) / (stddev_pop(fret * sig) + 1e-9) * sqrt(6048) AS gain FROM ff GROUP BY 1""",
       "symbol, trades_before, trades_after", "filter_rate, mean_phi, share_above, sharpe_before, sharpe_after, gain")
def _(t: Tables) -> DataFrame:
    return info.filter_statistics(_filtered(t), ["symbol"], "sig", "fret", 0.25)
