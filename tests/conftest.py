import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from barline.session import local_session

    session = local_session("4", partitions=4, memory="4g", scratch=str(tmp_path_factory.mktemp("scratch")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bars(spark):
    """Random-walk bars of three symbols; one of them holds most rows. Some hours are missing."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(42)
    frames = []
    for symbol, n in (("HOT", 700), ("MID", 120), ("ONE", 1)):
        hours = np.sort(rng.choice(int(n * 1.3) + 1, n, replace=False))
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        open_ = close * (1 + rng.normal(0, 0.005, n))
        frames.append(
            pd.DataFrame(
                {
                    "symbol": symbol,
                    "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, unit="h"),
                    "open": open_,
                    "high": np.maximum(open_, close) * 1.01,
                    "low": np.minimum(open_, close) * 0.99,
                    "close": close,
                    "volume": rng.integers(1, 50, n).astype(float),
                }
            )
        )
    pdf = pd.concat(frames, ignore_index=True).sample(frac=1.0, random_state=1)
    df = spark.createDataFrame(pdf).repartition(5).cache()
    df.count()
    return df


@pytest.fixture(scope="session")
def pbars(bars):
    return bars.toPandas().sort_values(["symbol", "ts"], ignore_index=True)
