"""Resampling by smooth curves: one spline a column through the known bins of a flight."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeunits import floor
from .keys import TIME
from .resample import resample


def knots(x: np.ndarray, order: int) -> np.ndarray:
    """Knots of a spline through x: the points themselves for odd orders, the middles for even ones, fewer by the ends."""
    inner = x if order % 2 else (x[1:] + x[:-1]) / 2
    cut = (order + 1) // 2
    return np.concatenate([np.repeat(x[0], order + 1), inner[cut : len(inner) - cut], np.repeat(x[-1], order + 1)])


def basis(t: np.ndarray, order: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and values of the order + 1 basis functions that are not zero at each x."""
    i = np.clip(np.searchsorted(t, x, side="right") - 1, order, len(t) - order - 2)
    b = np.zeros((len(x), order + 1))
    b[:, 0] = 1.0
    for d in range(1, order + 1):
        carried = np.zeros(len(x))
        for r in range(d):
            right, left = t[i + r + 1], t[i + 1 - d + r]
            share = b[:, r] / (right - left)
            b[:, r] = carried + (right - x) * share
            carried = (x - left) * share
        b[:, d] = carried
    return i - order, b


def solve_banded(first: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Solution of a system whose row j has its values from column first[j]; memory grows with the band only.

    Matrices of spline values need no exchange of rows.
    """
    n, k = len(y), rows.shape[1] - 1
    band = np.zeros((n, 2 * k + 1))
    j = np.arange(n)[:, None]
    band[j, first[:, None] - j + k + np.arange(k + 1)] = rows
    y = y.astype(float)
    for at in range(n):
        for m in range(1, min(k, n - 1 - at) + 1):
            share = band[at + m, k - m] / band[at, k]
            if share:
                band[at + m, k - m : 2 * k + 1 - m] -= share * band[at, k:]
                y[at + m] -= share * y[at]
    out = np.zeros(n + k)
    for at in range(n - 1, -1, -1):
        out[at] = (y[at] - band[at, k + 1 :] @ out[at + 1 : at + 1 + k]) / band[at, k]
    return out[:n]


def through(x: np.ndarray, y: np.ndarray, order: int, at: np.ndarray) -> np.ndarray:
    """Values at ``at`` of the spline through (x, y); none outside of x, or where there are order points or fewer."""
    if len(x) <= order:
        return np.full(len(at), np.nan)
    t = knots(x, order)
    c = solve_banded(*basis(t, order, x), y)
    first, b = basis(t, order, at)
    out = (b * c[first[:, None] + np.arange(order + 1)]).sum(axis=1)
    return np.where((at >= x[0]) & (at <= x[-1]), out, np.nan)


def resample_polynomial(df: DataFrame, by: list[str], rule, *cols: str, order: int = 2, ffill: tuple[str, ...] = ()) -> DataFrame:
    """One row per ``rule`` with splines of ``order`` through the first known values of the bins.

    Known bins keep their values; there is no value before the first known one
    or after the last.  A flight with ``order`` known bins or fewer keeps what
    is known.  The grid is made by built-in functions; a spline needs a whole
    flight, in one group.
    """
    stamps = {f"_at_{c}": F.when(F.col(c).isNotNull(), F.col(TIME)) for c in cols}
    grid = resample(df.withColumns(stamps), by, rule, (), (*cols, *ffill, *stamps))
    fresh = {c: F.when(floor(f"_at_{c}", rule) == F.col(TIME), F.col(c)).cast("double") for c in cols}
    grid = grid.withColumns(fresh).drop(*stamps)

    def fill(flight: pd.DataFrame) -> pd.DataFrame:
        flight = flight.sort_values(TIME)
        at = np.arange(len(flight), dtype=float)
        for c in cols:
            y = flight[c].to_numpy(float)
            known = ~np.isnan(y)
            flight[c] = np.where(known, y, through(at[known], y[known], order, at))
        return flight

    return grid.groupBy(*by).applyInPandas(fill, grid.schema)
