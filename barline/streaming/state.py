"""STR-03: keyed state with ``applyInPandasWithState``; STR-10 in batch form.

State per key is a few numbers. A trigger's rows of one key reach one task,
which keeps three numbers a row of them to put them in the order of their time
and walks them in steps, so the trigger size (``maxFilesPerTrigger``) is what
bounds a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barline.operators.positions import STOP, TARGET, TRAIL

#: Rows of a key that are walked at a time.
STEP_ROWS = 1 << 15
EXIT_SCHEMA = "symbol string, entry_ts timestamp, entry_price double, exit_ts timestamp, exit_price double, reason string"


def exit_reason(price: float, entry: float, peak: float) -> str | None:
    """Stop first, then target, then the trailing stop once the peak is above the entry."""
    if price <= entry * (1 - STOP):
        return "STOP_LOSS"
    if price >= entry * (1 + TARGET):
        return "TAKE_PROFIT"
    if peak > entry and price <= peak * (1 - TRAIL):
        return "TRAILING_STOP"
    return None


def follow(symbol: str, rows: pd.DataFrame, held: tuple | None) -> tuple[list[tuple], tuple | None]:
    """Walk ticks in time order: enter when flat, leave at the first exit rule.

    held: (entry time, entry price, peak) or None.
    """
    done = []
    for ts, price in zip(rows["ts"], rows["price"]):
        if held is None:
            held = (ts, price, price) if price > 0 else None
            continue
        entry_ts, entry, peak = held[0], held[1], max(held[2], price)
        reason = exit_reason(price, entry, peak)
        held = (entry_ts, entry, peak)
        if reason is not None:
            done.append((symbol, entry_ts, entry, ts, price, reason))
            held = None
    return done, held


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(
        rows, columns=["symbol", "entry_ts", "entry_price", "exit_ts", "exit_price", "reason"]
    )


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(ts, price) of all rows by (ts, event_id), in steps; rows are held as plain numbers, never as one frame."""
    held = {c: [] for c in ("ts", "event_id", "price")}
    for rows in batches:
        for c, parts in held.items():
            parts.append(rows[c].to_numpy(copy=True))
    ts, event_id, price = (np.concatenate(held.pop(c)) for c in ("ts", "event_id", "price"))
    order = np.lexsort((event_id, ts))
    del event_id
    for at in range(0, len(order), STEP_ROWS):
        step = order[at : at + STEP_ROWS]
        yield pd.DataFrame({"ts": ts[step], "price": price[step]})


def _monitor(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else None
    if held is not None:
        held = (pd.Timestamp(held[0]), held[1], held[2])
    for rows in _in_order(batches):
        done, held = follow(key[0], rows, held)
        yield _frame(done)
    if held is None:
        state.remove() if state.exists else None
    else:
        state.update((held[0].to_pydatetime(), float(held[1]), float(held[2])))


def monitor_positions(ticks: DataFrame) -> DataFrame:
    """STR-03: one row per closed position from a stream of (symbol, ts, price, event_id).

    ``operators.positions`` gives the same rows for bars at rest. Equal times follow event_id.
    """
    return ticks.groupBy("symbol").applyInPandasWithState(
        _monitor,
        outputStructType=EXIT_SCHEMA,
        stateStructType="entry_ts timestamp, entry_price double, peak double",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )


def hold_rows(actions: DataFrame, every: int = 12) -> DataFrame:
    """STR-10, batch form: every ``every``-th HOLD row of a symbol, in time order."""
    from pyspark.sql import functions as F

    from barline.operators.ordered import BARS

    holds = actions.filter("action = 'HOLD'").withColumn("_i", F.row_number().over(BARS.spec()))
    return holds.filter(F.col("_i") % every == 0).drop("_i")
