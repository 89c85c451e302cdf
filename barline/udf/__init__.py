"""User-supplied strategies and per-series functions (UDF)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from barline.schema import SIGNAL


class Strategy(Protocol):
    """UDF-01: bars in, signals (schema.SIGNAL) out, as a DataFrame transformation."""

    name: str

    def transform(self, bars: DataFrame) -> DataFrame: ...


def run_strategy(strategy: Strategy, bars: DataFrame) -> DataFrame:
    """Apply a strategy and hold it to the signal schema."""
    out = strategy.transform(bars)
    missing = [f.name for f in SIGNAL if f.name not in out.columns]
    if missing:
        raise TypeError(f"strategy {strategy.name} lacks {missing}")
    typed = out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SIGNAL])
    return typed.withColumn("strategy", F.lit(strategy.name))


def run_strategies(strategies: list[Strategy], bars: DataFrame) -> DataFrame:
    """UDF-04: all strategies over all symbols as one DataFrame keyed (strategy, symbol)."""
    return reduce(lambda a, b: a.unionByName(b), [run_strategy(s, bars) for s in strategies])


def apply_per_series(df: DataFrame, fn: Callable[[pd.DataFrame], float], name: str = "result") -> DataFrame:
    """UDF-02: a user function per symbol; an error becomes a row instead of a failed job.

    Each symbol's bars reach one Python worker: for bar tables bounded by the calendar.
    """

    def guarded(rows: pd.DataFrame) -> pd.DataFrame:
        symbol, size = rows["symbol"].iloc[0], len(rows)
        try:
            return pd.DataFrame([(symbol, True, None, size, float(fn(rows.sort_values("ts"))))])
        except Exception as e:  # the caller reads it from the error column
            return pd.DataFrame([(symbol, False, f"{type(e).__name__}: {e}", size, None)])

    schema = f"symbol string, success boolean, error string, data_size long, {name} double"
    return df.groupBy("symbol").applyInPandas(guarded, schema)


class SeriesFold(Protocol):
    """A function of a whole series, given in pieces: a piece and the state before it, to rows and the state after it."""

    def start(self) -> Any:
        """The state before the first row of a series."""

    def step(self, state: Any, rows: pd.DataFrame) -> tuple[Any, pd.DataFrame | None]:
        """The next rows in order -> the state after them and any rows to give out."""

    def finish(self, key: tuple, state: Any) -> pd.DataFrame | None:
        """Rows to give out once the series has ended."""


def fold_series(df: DataFrame, fold: SeriesFold, keys: list[str], order: list[str], schema: str) -> DataFrame:
    """UDF-02, chunked: a fold along each series, in pieces of at most one Arrow batch.

    A series is read by one task, since each step needs the state before it, but never held: the sort spills, rows pass
    in batches (``spark.sql.execution.arrow.maxRecordsPerBatch``), and only the state lives on. Series spread over the
    tasks by key. Null keys form a series of their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = state = None
        for batch in batches:
            if batch.empty:
                continue
            names = batch[keys]
            same = (names.eq(names.shift()) | (names.isna() & names.shift().isna())).all(axis=1).to_numpy()
            cuts = [0, *(i for i in range(1, len(batch)) if not same[i]), len(batch)] if not same[1:].all() else [0, len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                here = tuple(None if pd.isna(v) else v for v in names.iloc[a])
                if here != key:
                    if key is not None and (rest := fold.finish(key, state)) is not None:
                        yield rest
                    key, state = here, fold.start()
                state, out = fold.step(state, batch.iloc[a:b].reset_index(drop=True))
                if out is not None:
                    yield out
        if key is not None and (rest := fold.finish(key, state)) is not None:
            yield rest

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


class Guarded:
    """A fold to one number per series whose errors become a row: (success, error, rows, result)."""

    def __init__(self, start: Callable[[], Any], step: Callable[[Any, pd.DataFrame], Any], finish: Callable[[Any], float], columns: list[str]):
        self._start, self._step, self._finish, self._columns = start, step, finish, columns

    def _try(self, fn: Callable, *args) -> tuple[Any, str | None]:
        try:
            return fn(*args), None
        except Exception as e:  # the caller reads it from the error column
            return None, f"{type(e).__name__}: {e}"

    def start(self) -> tuple:
        return (*self._try(self._start), 0)

    def step(self, state: tuple, rows: pd.DataFrame) -> tuple[tuple, None]:
        value, error, size = state
        if error is None:
            value, error = self._try(self._step, value, rows)
        return (value, error, size + len(rows)), None

    def finish(self, key: tuple, state: tuple) -> pd.DataFrame:
        value, error, size = state
        if error is None:
            value, error = self._try(lambda: float(self._finish(value)))
        return pd.DataFrame([(*key, error is None, error, size, value if error is None else None)], columns=self._columns)


def reduce_series(
    df: DataFrame, start: Callable[[], Any], step: Callable[[Any, pd.DataFrame], Any], finish: Callable[[Any], float],
    keys: list[str], order: list[str], name: str = "result",
) -> DataFrame:
    """UDF-02 for series of any length: start() -> state, step(state, rows) -> state, finish(state) -> number."""
    types = {f.name: f.dataType.simpleString() for f in df.schema if f.name in keys}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "success boolean, error string, data_size long", f"`{name}` double"])
    fold = Guarded(start, step, finish, [*keys, "success", "error", "data_size", name])
    return fold_series(df, fold, keys, order, schema)
