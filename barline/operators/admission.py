"""RSK-09: admission of trades against drawdown and total exposure.

Whether a trade is granted depends on what was granted before, so each
portfolio is folded in time order, batch by batch: one number passes from a
batch to the next, and no portfolio is held whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from barline.udf import fold_series

# Limits as shares of the account.
MAX_DRAWDOWN, MAX_SIZE, MAX_EXPOSURE = 0.05, 0.10, 0.50


def _decide(size: float, drawdown: float, exposure: float) -> tuple[str, float]:
    """Drawdown first, then the size cap (which skips the exposure test), then exposure."""
    if drawdown >= MAX_DRAWDOWN:
        return "halted", 0.0
    if size > MAX_SIZE:
        return "reduced", MAX_SIZE
    if exposure + size > MAX_EXPOSURE:
        return "rejected", 0.0
    return "approved", size


class _Admission:
    """The exposure is all that one piece of a portfolio's requests hands to the next."""

    def start(self) -> float:
        return 0.0

    def step(self, exposure: float, requests: pd.DataFrame) -> tuple[float, pd.DataFrame]:
        rows = []
        for size, released, drawdown in zip(requests["size"], requests["released"], requests["drawdown"]):
            exposure = max(0.0, exposure - released)
            decision, granted = _decide(size, drawdown, exposure)
            exposure += granted
            rows.append((decision, granted, exposure))
        done = pd.DataFrame(rows, columns=["decision", "granted", "exposure"])
        return exposure, pd.concat([requests[["symbol", "ts"]], done], axis=1)

    def finish(self, key: tuple, exposure: float) -> None:
        return None


def admit(requests: DataFrame) -> DataFrame:
    """(symbol, ts, size, released, drawdown) -> decision, granted size and exposure after it."""
    schema = "symbol string, ts timestamp, decision string, granted double, exposure double"
    return fold_series(requests, _Admission(), ["symbol"], ["ts"], schema)
