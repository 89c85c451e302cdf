"""Phi of many short windows at once, for rolling use (SIG-16).

The array form in ``operators.info`` interprets its lambdas per element; for one
window per row this Arrow kernel does a batch of windows in a few NumPy calls.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def _entropy(p: np.ndarray, axis: int) -> np.ndarray:
    return -np.sum(np.where(p > 0, p * np.log2(np.where(p > 0, p, 1.0)), 0.0), axis=axis)


def phi_matrix(r: np.ndarray, n: int = 4) -> np.ndarray:
    """Mean of the three phi measures for each row of returns."""
    rows, k = r.shape
    if k == 0:
        return np.full(rows, 0.5)
    q = np.quantile(r, [i / n for i in range(n + 1)], axis=1).T
    inner = q[:, 1:-1]
    real = (inner > q[:, :1]) & (inner < q[:, -1:]) & (inner != q[:, :-2])
    s = ((r[:, None, :] >= inner[:, :, None]) & real[:, :, None]).sum(axis=1)
    p = (s[:, None, :] == np.arange(n)[None, :, None]).mean(axis=2)
    moves = s[:, :-1] * n + s[:, 1:]
    c = (moves[:, None, :] == np.arange(n * n)[None, :, None]).sum(axis=2).reshape(rows, n, n)
    total = c.sum(axis=2, keepdims=True)
    h, cond = _entropy(p, 1), (p * _entropy(c / np.maximum(total, 1), 2)).sum(axis=1)
    iit = np.clip((h - cond) / np.log2(n), 0, 1) if k >= 10 else np.full(rows, 0.5)
    share = h / np.log2(n)
    ent = np.clip(4 * share * (1 - share), 0, 1) if k >= 10 else np.full(rows, 0.5)
    return (iit + ent + _complexity(r)) / 3


def _complexity(r: np.ndarray) -> np.ndarray:
    rows, k = r.shape
    if k < 20:
        return np.full(rows, 0.5)
    found = []
    for lag in range(1, min(10, k // 2)):
        a = r[:, :-lag] - r[:, :-lag].mean(axis=1, keepdims=True)
        b = r[:, lag:] - r[:, lag:].mean(axis=1, keepdims=True)
        scale = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
        found.append(np.where(scale > 0, np.abs((a * b).sum(axis=1)) / np.where(scale > 0, scale, 1.0), np.nan))
    ac = np.array(found)
    seen = (~np.isnan(ac)).sum(axis=0)
    total = np.nansum(ac, axis=0)
    mean = total / np.maximum(seen, 1)
    sd = np.sqrt(np.nansum((ac - mean) ** 2, axis=0) / np.maximum(seen, 1))
    return np.where(seen < 2, 0.5, np.clip(mean * (1 + sd / (mean + 1e-10)) * 2, 0, 1))


@F.pandas_udf(T.DoubleType())
def phi_of_prices(windows: pd.Series) -> pd.Series:
    """Ensemble phi of the relative changes in each array of prices; zero bases are left out."""
    out = np.full(len(windows), np.nan)
    size = windows.map(len).to_numpy()
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        if n < 2:
            out[at] = 0.5
            continue
        w = np.stack(windows.iloc[at].to_numpy()).astype(float)
        whole = (w[:, :-1] != 0).all(axis=1)
        if whole.any():
            w_ok = w[whole]
            out[at[whole]] = phi_matrix(w_ok[:, 1:] / w_ok[:, :-1] - 1)
        for i in np.flatnonzero(~whole):
            base = w[i, :-1]
            out[at[i]] = phi_matrix((w[i, 1:][base != 0] / base[base != 0] - 1)[None, :])[0]
    return pd.Series(out)
