"""Sliding medians and spikes against plain loops."""

import time

import numpy as np
import pytest

from tempora.operators import sliding


def by_loops(v: np.ndarray, sensitivity: int) -> np.ndarray:
    """The rule of spikes, value by value."""
    thr, most = max(4, 12 - sensitivity), [1, 2, 3, 4, 5, 6, 8, 10, 13, 16][sensitivity - 1]
    good, n = np.isfinite(v), len(v)

    def spread(x: np.ndarray, m: float) -> float:
        s = 1.4826 * np.median(np.abs(x - m))
        return s if s > 0 else max(32 * np.finfo(float).eps * max(1, abs(m)), 1e-12)

    flag = np.zeros(n, bool)
    for i in np.flatnonzero(good):
        x = v[max(0, i - 25) : i + 26]
        x = x[np.isfinite(x)]
        if len(x) >= 3:
            m = np.median(x)
            flag[i] = abs(v[i] - m) > thr * spread(x, m)
    out, i = np.zeros(n, bool), 0
    while i < n:
        if not flag[i]:
            i += 1
            continue
        j = i
        while j + 1 < n and flag[j + 1]:
            j += 1
        if j - i + 1 <= most:
            a, b = i, j
            lo, hi = v[max(0, a - 25) : a], v[b + 1 : b + 26]
            lo, hi = lo[np.isfinite(lo)], hi[np.isfinite(hi)]
            if len(lo) and len(hi):
                around = np.concatenate([lo, hi])
                m = np.median(around)
                s = thr * spread(around, m)
                run = np.median(v[i : j + 1])
                like = max(s, 32 * np.finfo(float).eps * max(1, abs(run)), 1e-12)  # how far the run's own values may be
                while a > 0 and np.isfinite(v[a - 1]) and abs(v[a - 1] - run) <= like and b - a + 1 <= most:
                    a -= 1
                while b + 1 < n and np.isfinite(v[b + 1]) and abs(v[b + 1] - run) <= like and b - a + 1 <= most:
                    b += 1
                out[i : j + 1] = abs(np.median(lo) - np.median(hi)) <= s and b - a + 1 <= most and abs(run - m) > s
        i = j + 1
    return out


def signals():
    rng = np.random.default_rng(8)
    for k in range(20):
        v = np.cumsum(rng.normal(size=400)) if k % 2 else rng.normal(size=400) + np.sin(np.arange(400) / 9)
        v = np.round(v, k % 4)  # ties, and windows that do not deviate
        for a in rng.integers(0, 395, 12):
            v[a : a + rng.integers(1, 9)] += rng.choice([-60, 25, 90])
        v[rng.integers(0, 400, 15)] = np.nan
        v[rng.integers(0, 400, 3)] = np.inf
        yield np.full(400, 2.0) if k == 7 else v


@pytest.mark.parametrize("sensitivity", [1, 4, 6, 10])
def test_spikes_are_those_of_loops(sensitivity, monkeypatch):
    monkeypatch.setattr(sliding, "BLOCK", 150)
    found = 0
    for v in signals():
        got = sliding.spikes(v, sensitivity)
        assert (got == by_loops(v, sensitivity)).all()
        found += got.sum()
    assert found > 15


@pytest.mark.parametrize("width", [1, 2, 5, 51])
def test_medians_of_windows(width):
    for v in signals():
        n, med, mad = sliding.rolling(v, width)
        for i in range(0, 400, 7):
            x = v[max(0, i - (width - 1) // 2) : i + width // 2 + 1]
            x = x[np.isfinite(x)]
            assert n[i] == len(x) and (med[i] == np.median(x) and mad[i] == np.median(np.abs(x - np.median(x))) if len(x) else np.isnan(med[i]))


def test_a_million_rows():
    v = np.random.default_rng(3).normal(size=1_000_000)
    v[::1000] += 40
    start = time.process_time()
    assert 900 <= sliding.spikes(v)[::1000].sum() <= 1000
    assert time.process_time() - start < 12  # about 2 s on an idle machine


@pytest.mark.parametrize("rows", [60, 5000])
def test_chunks_make_no_difference(spark, rows):
    v = np.concatenate([next(signals()), *signals()][:3])
    s = spark.createDataFrame([(i, float(i), float(x)) for i, x in enumerate(v)], "_i long, t double, v double")
    got = [r.outlier for r in sliding.outliers_spike(s, rows=rows).orderBy("_i").collect()]
    assert got == sliding.spikes(v).tolist()
    n, med, mad = sliding.rolling(v, 21)
    out = sliding.rolling_median(s, 21, rows).orderBy("_i").collect()
    assert [(r.n, r.median, r.mad) for r in out] == [(a, b, c) if a else (0, None, None) for a, b, c in zip(n.tolist(), med.tolist(), mad.tolist())]
    assert sliding.outliers_spike(s.limit(0)).count() == 0
