"""Medians and median absolute deviations of centred windows, and the outliers that they show.

A chunk of rows is a matrix of its windows, a view without copies; blocks of windows are
sorted at once. Chunks carry the rows of their neighbours that a decision reaches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .ordering import chunked

#: Windows that are sorted at once.
BLOCK = 1 << 13
#: Rows of a spike's window, and on either side of a run.
WINDOW, SIDE = 51, 25
#: The longest run of outliers by sensitivity 1 to 10 (fixed values).
LONGEST = [1, 2, 3, 4, 5, 6, 8, 10, 13, 16]
EPS = np.finfo(float).eps


def middles(ordered: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The medians of rows that are in order, of which the first ``n`` values count."""
    at = np.arange(len(ordered))
    lo, hi = np.maximum(n - 1, 0) // 2, np.minimum(n // 2, ordered.shape[1] - 1)
    return np.where(n > 0, (ordered[at, lo] + ordered[at, hi]) / 2, np.nan)


def windows(v: np.ndarray, width: int) -> np.ndarray:
    """A row of ``width`` values around each value; beyond the ends, and for what is not finite, NaN."""
    left = (width - 1) // 2
    clean = np.where(np.isfinite(v), v, np.nan)
    padded = np.concatenate([np.full(left, np.nan), clean, np.full(width - 1 - left, np.nan)])
    return np.lib.stride_tricks.sliding_window_view(padded, width)


def rolling(v: np.ndarray, width: int, deviation: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, median and median absolute deviation of the finite values of each window."""
    n, med, mad = np.zeros(len(v), int), np.full(len(v), np.nan), np.full(len(v), np.nan)
    rows = windows(v, width)
    for a in range(0, len(v), BLOCK):
        some, part = rows[a : a + BLOCK], slice(a, a + BLOCK)
        n[part] = np.isfinite(some).sum(1)
        med[part] = middles(np.sort(some, axis=1), n[part])  # NaN comes last
        if deviation:
            mad[part] = middles(np.sort(np.abs(some - med[part, None]), axis=1), n[part])
    return n, med, mad


def scales(mad: np.ndarray, med: np.ndarray) -> np.ndarray:
    """Standard deviations by median absolute deviations; where these are 0, what numbers of this size can tell apart."""
    s = 1.4826 * mad
    return np.where(s > 0, s, np.maximum(32 * EPS * np.maximum(1, np.abs(med)), 1e-12))


def flagged(v: np.ndarray, times: float) -> np.ndarray:
    """Finite values further than ``times`` scales from the median of their window of three finite values or more."""
    n, med, _ = rolling(v, WINDOW, deviation=False)
    off = np.abs(np.where(np.isfinite(v), v, np.nan) - med)
    # a deviation below off / (1.4826 times) needs half the window nearer than that: most windows are settled by a count
    near, rows = off / (1.4826 * times) * (1 + 1e-9), windows(v, WINDOW)
    out = np.zeros(len(v), bool)
    for a in range(0, len(v), BLOCK):
        some, m = rows[a : a + BLOCK], med[a : a + BLOCK]
        with np.errstate(invalid="ignore"):
            inside = (np.abs(some - m[:, None]) < near[a : a + BLOCK, None]).sum(1)
        at = a + np.flatnonzero((2 * inside >= n[a : a + BLOCK]) & (n[a : a + BLOCK] >= 3) & np.isfinite(v[a : a + BLOCK]))
        if len(at):
            mad = middles(np.sort(np.abs(rows[at] - med[at, None]), axis=1), n[at])
            out[at] = off[at] > times * scales(mad, med[at])
    return out


def spikes(v: np.ndarray, sensitivity: int = 6) -> np.ndarray:
    """Which values belong to a short run that stands out and from which the signal returns."""
    times, longest = max(4, 12 - sensitivity), LONGEST[sensitivity - 1]
    flag, out = flagged(v, times), np.zeros(len(v), bool)
    change = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
    for a, b in zip(change[::2], change[1::2], strict=True):
        lo, hi = (x[np.isfinite(x)] for x in (v[max(0, a - SIDE) : a], v[b : b + SIDE]))
        if b - a > longest or not len(lo) or not len(hi):
            continue
        both = np.concatenate([lo, hi])
        med, run = np.median(both), np.median(v[a:b])
        far = times * float(scales(np.median(np.abs(both - med)), med))
        like = max(far, 32 * EPS * max(1, abs(run)), 1e-12)  # how far the values beside may be from the run's to belong to it
        size = b - a + _like(v[max(0, a - longest) : a][::-1], run, like) + _like(v[b : b + longest], run, like)
        out[a:b] = size <= longest and abs(np.median(lo) - np.median(hi)) <= far and abs(run - med) > far
    return out


def _like(beside: np.ndarray, run: float, like: float) -> int:
    """How many values, from the first on, are like the run's."""
    with np.errstate(invalid="ignore"):
        other = ~(np.isfinite(beside) & (np.abs(beside - run) <= like))
    return int(other.argmax()) if other.any() else len(beside)


def rolling_median(s: DataFrame, width: int = WINDOW, rows: int = 50_000) -> DataFrame:
    """An indexed series with ``median``, ``mad`` and ``n`` of the finite values in a centred window of rows; null where there are none."""
    left = (width - 1) // 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        pdf["n"], pdf["median"], pdf["mad"] = rolling(pdf["v"].to_numpy(float), width)
        return pdf.loc[~pdf["_halo"], ["_i", "n", "median", "mad"]].astype(object).where(lambda x: x.notna(), None)

    found = chunked(s.select("_i", "v"), left, width - 1 - left, rows).groupBy("_chunk").applyInPandas(run, "_i long, n long, median double, mad double")
    return s.join(found, "_i")


def outliers_spike(s: DataFrame, sensitivity: int = 6, rows: int = 50_000) -> DataFrame:
    """``s`` with ``outlier``; chunks of rows carry 128 rows of their neighbours, which is as far as a decision reaches."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        pdf["outlier"] = spikes(pdf["v"].to_numpy(float), sensitivity)
        return pdf.loc[~pdf["_halo"], ["_i", "outlier"]]

    flags = chunked(s.select("_i", "v"), 128, 128, rows).groupBy("_chunk").applyInPandas(run, "_i long, outlier boolean")
    return s.join(flags, "_i")
