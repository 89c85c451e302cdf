"""Information measures (INF).

INF-01..05 are grouped counts of any size. The phi family works on a short
trailing window (100 rows), held as one array per row or per symbol and folded
with higher-order functions, so nothing leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from barline.operators.ordered import BARS, Series
from barline.operators.quality import attach
from barline.operators.quantiles import exact_quantiles

STATES = 4
LOOKBACK = 100


# --- grouped counts --------------------------------------------------------


def _digitize(x: Column, edges: Column, n: int) -> Column:
    """Number of inner edges at or below x."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.least(F.size(F.filter(inner, lambda e: e <= x)), F.lit(n - 1))


def with_states(
    df: DataFrame, x: str, keys: list[str], out: str, n: int = STATES, how: str = "quantile", bounded: bool = False
) -> DataFrame:
    """INF-01: state 0..n-1 by distinct quantile edges, or by edges of equal width."""
    if how == "quantile":
        edges = exact_quantiles(df, keys, x, [i / n for i in range(n + 1)], bounded=bounded).select(
            *keys, F.array_distinct("q").alias("_edges")
        )
    else:
        lo, hi = F.col("_lo"), F.col("_hi")
        edges = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")).select(
            *keys,
            F.when(hi - lo < 1e-10, F.array(lo))
            .otherwise(F.array(*[lo + (hi - lo) * (i / n) for i in range(n + 1)]))
            .alias("_edges"),
        )
    return attach(df, edges, keys, bounded).withColumn(out, _digitize(F.col(x), F.col("_edges"), n)).drop("_edges")


def transition_matrix(states: DataFrame, keys: list[str], state: str, series: Series = BARS) -> DataFrame:
    """INF-02: share of each next state, long form."""
    pairs = states.withColumn("_next", F.lead(state).over(series.spec())).dropna(subset=["_next"])
    counts = pairs.groupBy(*keys, F.col(state).alias("state"), F.col("_next").alias("next_state")).agg(
        F.count("*").alias("n")
    )
    total = Window.partitionBy(*keys, "state")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(total))


def entropy(states: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """INF-03: bits of the joint distribution of the state columns; one cell row per state."""
    cells = states.groupBy(*keys, *columns).agg(F.count("*").alias("_n"))
    p = F.col("_n") / F.sum("_n").over(Window.partitionBy(*keys))
    return cells.withColumn("_p", p).groupBy(*keys).agg(F.sum(-F.col("_p") * F.log2("_p")).alias("entropy"))


def mutual_information(states: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """INF-04: from the joint counts alone; floored at 0."""
    cells = states.groupBy(*keys, a, b).agg(F.count("*").alias("_n"))

    def total(*by: str) -> Column:
        return F.sum("_n").over(Window.partitionBy(*keys, *by))

    d = cells.withColumns({"_t": total(), "_na": total(a), "_nb": total(b)})
    bits = F.col("_n") / F.col("_t") * F.log2(F.col("_n") * F.col("_t") / (F.col("_na") * F.col("_nb")))
    return d.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.sum(bits)).alias("mutual_information"))


def transfer_entropy(
    states: DataFrame, keys: list[str], source: str, target: str, lag: int = 1, series: Series = BARS
) -> DataFrame:
    """INF-05: H(Yt | Yt-l) - H(Yt | Yt-l, Xt-l) from one count of at most 64 cells per key."""
    back = states.withColumns(
        {
            "_y": F.col(target),
            "_yp": F.lag(target, lag).over(series.spec()),
            "_xp": F.lag(source, lag).over(series.spec()),
        }
    ).dropna(subset=["_yp", "_xp"])
    cells = back.groupBy(*keys, "_y", "_yp", "_xp").agg(F.count("*").alias("_n"))

    def total(*by: str) -> Column:
        return F.sum("_n").over(Window.partitionBy(*keys, *by))

    d = cells.withColumns(
        {"_t": total(), "_yy": total("_y", "_yp"), "_p": total("_yp"), "_px": total("_yp", "_xp")}
    )
    gain = F.col("_n") / F.col("_t") * F.log2(F.col("_n") / F.col("_px") * F.col("_p") / F.col("_yy"))
    out = d.groupBy(*keys).agg(F.first("_t").alias("_t"), F.sum(gain).alias("_te"))
    return out.select(
        *keys,
        F.when(F.col("_t") + lag < lag + 10, 0.0).otherwise(F.greatest(F.lit(0.0), "_te")).alias("transfer_entropy"),
    )


# --- short windows as arrays ----------------------------------------------
# Each function maps the name of an array<double> column to SQL text over it.


def _let(name: str, value: str, body: str) -> str:
    """Bind a value for the lambdas in ``body``, so it is computed once per row and not per element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _edges(r: str, n: int = STATES) -> str:
    """Inner distinct quantile edges of an array."""
    points = []
    for i in range(n + 1):
        rank = f"((size(o) - 1) * {i / n}D)"
        lo = f"try_element_at(o, greatest(int(floor({rank})) + 1, 1))"
        hi = f"try_element_at(o, greatest(int(ceil({rank})) + 1, 1))"
        points.append(f"{lo} + ({hi} - {lo}) * ({rank} - floor({rank}))")
    distinct = _let("o", f"array_sort({r})", f"array_distinct(array({', '.join(points)}))")
    return _let("d", distinct, "slice(d, 2, greatest(size(d) - 2, 0))")


def _add(df: DataFrame, **cols: str) -> DataFrame:
    for name, sql in cols.items():
        df = df.withColumn(name, F.expr(sql))
    return df


def _states(df: DataFrame, r: str, tag: str, n: int = STATES) -> DataFrame:
    below = f"transform({r}, x -> size(filter(e, b -> b <= x)))"
    return _add(df, **{f"_s{tag}": _let("e", _edges(r, n), below)})


def _cell_entropy(codes: str, k: int) -> str:
    counts = f"transform(sequence(0, {k - 1}), c -> size(filter({codes}, v -> v = c)) / nullif(size({codes}), 0))"
    return f"aggregate({counts}, 0D, (a, p) -> a - if(p > 0, p * log2(p), 0D))"


def _univariate(df: DataFrame, r: str, tag: str, out: str, n: int = STATES) -> DataFrame:
    """(H - sum_i p_i H(next | i)) / log2 n on one array; 0.5 below 10 values."""
    df = _states(df, r, tag, n)
    s = f"_s{tag}"
    df = _add(
        df,
        **{
            f"_t{tag}": f"zip_with(slice({s}, 1, greatest(size({s}) - 1, 0)), slice({s}, 2, greatest(size({s}) - 1, 0)), (a, b) -> a * {n} + b)",
            f"_h{tag}": _cell_entropy(s, n),
        },
    )
    count = f"size(filter(_t{tag}, v -> v = i * {n} + j))"
    base = f"size(filter(_t{tag}, v -> int(v / {n}) = i))"
    row = f"aggregate(sequence(0, {n - 1}), 0D, (a, j) -> a - if({count} > 0, {count} / {base} * log2({count} / {base}), 0D))"
    cond = f"aggregate(sequence(0, {n - 1}), 0D, (b, i) -> b + size(filter({s}, v -> v = i)) / size({s}) * if({base} > 0, {row}, 0D))"
    phi = f"if(size({r}) < 10, 0.5D, greatest(0D, least(1D, (_h{tag} - {cond}) / {math.log2(n)!r}D)))"
    return _add(df, **{out: phi}).drop(f"_t{tag}")


def _entropy_phi(h: str, r: str, n: int = STATES) -> str:
    x = f"({h} / {math.log2(n)!r}D)"
    return f"if(size({r}) < 10, 0.5D, greatest(0D, least(1D, 4 * {x} * (1 - {x}))))"


def _mean(a: str) -> str:
    return f"(aggregate({a}, 0D, (m, v) -> m + v) / nullif(size({a}), 0))"


def _complexity(df: DataFrame, r: str, out: str) -> DataFrame:
    """Mean absolute autocorrelation at lags 1-9, raised by its spread; 0.5 below 20 values."""
    head = f"slice({r}, 1, size({r}) - k)"
    tail = f"slice({r}, k + 1, size({r}) - k)"
    # Pearson of the two cuts, from sums of one zipped pass.
    sums = (
        f"aggregate(zip_with({head}, {tail}, (x, y) -> struct(x AS x, y AS y)), "
        "struct(0D AS n, 0D AS x, 0D AS y, 0D AS xx, 0D AS yy, 0D AS xy), "
        "(a, p) -> struct(a.n + 1D AS n, a.x + p.x AS x, a.y + p.y AS y, a.xx + p.x * p.x AS xx, a.yy + p.y * p.y AS yy, a.xy + p.x * p.y AS xy), "
        "a -> if((a.n * a.xx - a.x * a.x) * (a.n * a.yy - a.y * a.y) > 1e-18D, "
        "abs(a.n * a.xy - a.x * a.y) / sqrt((a.n * a.xx - a.x * a.x) * (a.n * a.yy - a.y * a.y)), NULL))"
    )
    lags = f"sequence(1, greatest(least(9, int(size({r}) / 2) - 1), 1))"
    df = _add(df, _ac=f"if(size({r}) < 20, array(), array_compact(transform({lags}, k -> {sums})))")
    df = _add(df, _am=_mean("_ac"))
    df = _add(df, _asd="sqrt(aggregate(_ac, 0D, (s, v) -> s + (v - _am) * (v - _am)) / nullif(size(_ac), 0))")
    value = "greatest(0D, least(1D, _am * (1 + _asd / (_am + 1e-10D)) * 2))"
    return _add(df, **{out: f"if(size(_ac) < 2, 0.5D, {value})"}).drop("_ac", "_am", "_asd")


def phi_columns(df: DataFrame, r: str, v: str | None = None, n: int = STATES) -> DataFrame:
    """INF-06: phi_iit (two-variable when ``v`` is given), phi_entropy, phi_complexity, their mean and the entropy."""
    df = _univariate(df, r, "r", "_phi_r", n)
    if v is not None:
        df = _univariate(df, v, "v", "_phi_v", n)
        df = _add(df, _j=f"zip_with(_sr, _sv, (a, b) -> a * {n} + b)")
        mi = f"greatest(0D, _hr + _hv - {_cell_entropy('_j', n * n)})"
        both = f"greatest(0D, least(1D, ({mi} / {math.log2(n)!r}D + _phi_r + _phi_v) / 3))"
        df = _add(df, phi_iit=f"if(size({r}) < 10, 0.5D, {both})").drop("_j", "_sv", "_hv", "_phi_v")
    else:
        df = _add(df, phi_iit="_phi_r")
    df = _add(df, phi_entropy=_entropy_phi("_hr", r, n), raw_entropy="_hr")
    df = _complexity(df, r, "phi_complexity").drop("_sr", "_hr", "_phi_r")
    return _add(df, phi="(phi_iit + phi_entropy + phi_complexity) / 3")


def trailing_arrays(bars: DataFrame, columns: dict[str, str], n: int, series: Series = BARS) -> DataFrame:
    """INF-06..08: for every row that ends a window of n rows, those rows as arrays in series order.

    One array of n values per row and column; use ``ordered.rolling`` with halo n on long series.
    """
    full = F.count(F.lit(1)).over(series.last(n)) >= n
    d = bars.withColumns({name: F.collect_list(c).over(series.last(n)) for name, c in columns.items()} | {"_full": full})
    return d.filter("_full").select(*series.keys, *series.order, *columns)


def changes(a: str) -> str:
    """Relative changes between neighbours of an array, zero bases left out."""
    pairs = f"zip_with(slice({a}, 1, greatest(size({a}) - 1, 0)), slice({a}, 2, greatest(size({a}) - 1, 0)), (p, c) -> c / nullif(p, 0D) - 1)"
    return f"array_compact({pairs})"


def regime_columns(df: DataFrame, r: str, phi: str = "phi") -> DataFrame:
    """INF-07: regime by phi, mean, spread and the 75th percentile of absolute values; confidence."""
    df = _add(df, _m=_mean(r), _abs=f"array_sort(transform({r}, x -> abs(x)))")
    rank = "((size(_abs) - 1) * 0.75D)"
    lo, hi = f"try_element_at(_abs, greatest(int(floor({rank})) + 1, 1))", f"try_element_at(_abs, greatest(int(ceil({rank})) + 1, 1))"
    df = _add(
        df,
        _sd=f"sqrt(aggregate({r}, 0D, (s, v) -> s + (v - _m) * (v - _m)) / nullif(size({r}), 0))",
        _p75=f"{lo} + ({hi} - {lo}) * ({rank} - floor({rank}))",
    )
    return _add(
        df,
        regime=f"""CASE WHEN {phi} > 0.7 AND _m > 0 THEN 'trending_up' WHEN {phi} > 0.7 AND _m < 0 THEN 'trending_down'
          WHEN {phi} > 0.7 THEN 'integrated_neutral' WHEN {phi} > 0.4 THEN 'complex' WHEN _sd > _p75 THEN 'chaotic' ELSE 'random' END""",
        confidence=f"(least(1D, size({r}) / 100D) + 1 - 2 * abs({phi} - 0.5D)) / 2",
    ).drop("_m", "_abs", "_sd", "_p75")


def proxy_record(df: DataFrame) -> DataFrame:
    """INF-08: one struct with the distinctly named measures."""
    names = ["phi_iit", "phi_entropy", "phi_complexity", "phi", "raw_entropy", "regime", "confidence"]
    return df.withColumn("proxy", F.struct(*names))


def lempel_ziv(r: str) -> str:
    """INF-09: phrases of the median-binarised series against n / log2 n.

    A fold over end positions: a phrase grows while it occurs in the text before
    its start, else it is counted and the next one starts.
    """
    ordered = f"array_sort({r})"
    n = f"size({r})"
    median = f"((element_at({ordered}, int(floor(({n} - 1) / 2)) + 1) + element_at({ordered}, int(ceil(({n} - 1) / 2)) + 1)) / 2)"
    text = f"array_join(transform({r}, x -> if(x > {median}, '1', '0')), '')"
    fold = (
        f"aggregate(sequence(1, {n}), struct({text} AS s, 0 AS i, 1 AS c), "
        "(a, e) -> if(instr(substr(a.s, 1, a.i), substr(a.s, a.i + 1, e - a.i)) > 0, a, struct(a.s AS s, e AS i, a.c + 1 AS c)), a -> a.c)"
    )
    return f"if({n} > 1, least(1D, {fold} / ({n} / log2({n}))), 0.5D)"


def sample_entropy(df: DataFrame, r: str, out: str, m: int = 2, share: float = 0.2) -> DataFrame:
    """INF-10: matches of length m and m+1 within share * sd, counted inside the array; 0.5 when undefined."""
    df = _add(df, _m=_mean(r))
    df = _add(df, _tol=f"{share}D * sqrt(aggregate({r}, 0D, (s, v) -> s + (v - _m) * (v - _m)) / nullif(size({r}), 0))")

    def matches(length: int) -> str:
        close = " AND ".join(f"abs({r}[i + {k}] - {r}[j + {k}]) < _tol" for k in range(length))
        last = f"size({r}) - {length} - 1"
        inner = f"size(filter(sequence(i + 1, {last}), j -> {close}))"
        return f"if(size({r}) < {m + 2}, 0L, aggregate(sequence(0, {last}), 0L, (acc, i) -> acc + if(i < {last}, {inner}, 0)))"

    df = _add(df, _a=matches(m), _b=matches(m + 1))
    value = "if(_tol < 1e-10D OR _a = 0 OR _b = 0, 0.5D, greatest(0D, least(1D, 1 - _b / _a)))"
    return _add(df, **{out: value}).drop("_m", "_tol", "_a", "_b")


def autocorrelation_complexity(df: DataFrame, r: str, out: str) -> DataFrame:
    """INF-11: mean and spread of absolute autocorrelations at lags below min(20, n/3)."""
    df = _add(df, _c=_let("m", _mean(r), f"transform({r}, x -> x - m)"))
    df = _add(df, _var="aggregate(_c, 0D, (s, v) -> s + v * v) / nullif(size(_c), 0)")
    dot = "aggregate(zip_with(slice(_c, 1, size(_c) - k), slice(_c, k + 1, size(_c) - k), (x, y) -> x * y), 0D, (s, v) -> s + v)"
    df = _add(df, _ac=f"if(size(_c) < 20 OR _var < 1e-10D, array(), transform(sequence(1, greatest(1, least(20, int(size(_c) / 3)) - 1)), k -> abs({dot} / ((size(_c) - k) * _var))))")
    df = _add(df, _am=_mean("_ac"))
    df = _add(df, _asd="sqrt(aggregate(_ac, 0D, (s, v) -> s + (v - _am) * (v - _am)) / nullif(size(_ac), 0))")
    value = "CASE WHEN size(_c) < 20 THEN 0.5D WHEN _var < 1e-10D THEN 0D WHEN size(_ac) < 2 THEN 0.5D ELSE greatest(0D, least(1D, (_am + _asd) / 2 * 3)) END"
    return _add(df, **{out: value}).drop("_c", "_var", "_ac", "_am", "_asd")


def rolling_phi(bars: DataFrame, price: str = "close", n: int = LOOKBACK, series: Series = BARS) -> DataFrame:
    """SIG-16, first half: phi of the n rows before each row; 0.5 until there are n.

    One array of n values per row; use ``ordered.rolling`` with halo n on long series.
    """
    from barline.functions.phi import phi_of_prices

    d = bars.withColumn("_w", F.collect_list(price).over(series.previous(n)))
    phi = F.when(F.size("_w") >= n, phi_of_prices("_w")).otherwise(0.5)
    return d.withColumn("phi", phi).drop("_w")


def phi_filter(df: DataFrame, signal: str, threshold: float = 0.5, stable_rows: int = 5, series: Series = BARS) -> DataFrame:
    """SIG-16, second half: keep a signal where phi stayed above the threshold for ``stable_rows`` rows."""
    from barline.functions.windows import stable

    keep = F.coalesce(stable(F.col("phi") > threshold, stable_rows, series), F.lit(False))
    return df.withColumn("filtered", F.col(signal) * keep.cast("int"))


def filter_statistics(df: DataFrame, keys: list[str], signal: str, ret: str, threshold: float = 0.5) -> DataFrame:
    """SIG-17: trades before and after, rate, phi share and Sharpe both ways (hourly, population deviation)."""
    root = F.lit((252 * 24) ** 0.5)
    before, after = F.col(ret) * F.col(signal), F.col(ret) * F.col("filtered")

    def sharpe(x: Column) -> Column:
        return F.avg(x) / (F.stddev_pop(x) + 1e-9) * root

    return df.groupBy(*keys).agg(
        F.sum(signal).alias("trades_before"),
        F.sum("filtered").alias("trades_after"),
        F.when(F.sum(signal) > 0, 1 - F.try_divide(F.sum("filtered"), F.sum(signal))).otherwise(0.0).alias("filter_rate"),
        F.avg("phi").alias("mean_phi"),
        F.avg((F.col("phi") > threshold).cast("int")).alias("share_above"),
        sharpe(before).alias("sharpe_before"),
        sharpe(after).alias("sharpe_after"),
        (sharpe(after) - sharpe(before)).alias("gain"),
    )
