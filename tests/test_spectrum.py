"""Spectra over many tasks against one numpy transform, and quantiles of many series against numpy's."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempora.operators import quantiles, spectrum


def one_transform(v, window, pad, step):
    """Frequencies and amplitudes by a single transform."""
    n = len(v)
    x = 2 * np.pi * np.arange(n) / n
    w = sum(a * np.cos(k * x) for k, a in enumerate(spectrum.WINDOWS[window]))
    size = 2 ** int(np.ceil(np.log2(n))) * pad
    amp = np.abs(np.fft.rfft((v - v.mean()) * w, size)) / w.sum()
    amp[1 : (size + 1) // 2] *= 2
    return np.fft.rfftfreq(size, step), amp


def frame(spark, series):
    rows = pd.concat([pd.DataFrame({"s": s, "t": np.asarray(t, float), "v": np.asarray(v, float), "k": np.arange(len(v))}) for s, (t, v) in series.items()])
    return spark.createDataFrame(rows.sample(frac=1, random_state=1))


@pytest.mark.parametrize("leaf", [4, 16, 1 << 14])
@pytest.mark.parametrize("window,pad", [("hann", 1), ("flattop", 4), ("none", 16)])
def test_transform_of_pieces_is_one_transform(spark, leaf, window, pad):
    rng = np.random.default_rng(leaf)
    series = {f"s{n}": (np.arange(n) * 0.5 + 3, rng.normal(size=n)) for n in (2, 3, 8, 100, 257)}
    out = spectrum.spectrum(frame(spark, series), "s", window=window, pad=pad, unit=1.0, leaf=leaf, rows=40).toPandas()
    for s, (_, v) in series.items():
        got = out[out.s == s].sort_values("k")
        f, a = one_transform(v, window, pad, 0.5)
        assert got.k.tolist() == list(range(len(f))) and np.allclose(got.frequency, f) and np.allclose(got.amplitude, a, atol=1e-12)


def test_states_of_series(spark):
    n = np.arange(50.0)
    jitter = n + np.random.default_rng(2).uniform(-2e-4, 2e-4, 50)
    holes = np.where(n == 7, np.nan, 1.0)
    series = {"nan": (n, holes), "far": (np.where(n > 30, n + 5, n), n), "short": ([1.0, 1.0], [1.0, 2.0]), "jitter": (jitter, np.sin(n)), "twice": (np.repeat(n, 2), np.tile([9.0, 1.0], 50)), "bad": (np.where(n == 3, np.nan, n), n)}
    out = spectrum.spectrum(frame(spark, series), "s", unit=1.0, key="k").toPandas()
    assert out.groupby("s").status.first().to_dict() == {"nan": "nan", "far": "nonUniform", "short": "tooShort", "jitter": "ok", "twice": "ok", "bad": "invalidTime"}
    got = out[out.s == "jitter"].sort_values("k")
    f, a = one_transform(np.sin(n), "hann", 1, np.median(np.diff(jitter)))
    assert np.allclose(got.frequency, f, rtol=1e-12) and np.allclose(got.amplitude, a)
    assert np.allclose(out[out.s == "twice"].amplitude, 0, atol=1e-12)  # the last of equal times wins: a constant
    assert spectrum.spectrum(frame(spark, series).limit(0), "s").count() == 0


def test_a_million_points_in_small_groups(spark):
    n = 1 << 20
    df = spark.range(n).select(F.lit("x").alias("s"), F.col("id").cast("double").alias("t"), (F.sin(F.col("id") * 0.1) + (F.col("id") * 7919 % 1000) / 1000).alias("v"))
    assert spectrum.shape(n, 1) == (1024, 1024)
    out = spectrum.spectrum(df, "s", unit=1.0)
    got = out.orderBy("k").select("k", "amplitude").toPandas()
    i = np.arange(n)
    _, a = one_transform(np.sin(i * 0.1) + (i * 7919 % 1000) / 1000, "hann", 1, 1.0)
    assert np.allclose(got.amplitude, a, atol=1e-9) and len(got) == n // 2 + 1
    # a group of sub-series, and one of columns, has LEAF points
    each = spectrum.LEAF // 1024
    groups = df.groupBy(F.floor((F.col("t") % 1024) / each)).count()
    assert groups.agg(F.max("count")).first()[0] <= spectrum.LEAF


def test_decibels(spark):
    df = spark.createDataFrame([(1.0,), (0.1,), (0.0,)], "a double")
    assert [round(r[0], 6) for r in df.select(spectrum.decibels(F.col("a"))).collect()] == [0, -20, -200]
    assert [round(r[0], 6) for r in df.select(spectrum.decibels(F.col("a"), F.lit(10.0))).collect()] == [-20, -40, -200]
    assert {r[0] for r in df.select(spectrum.decibels(F.col("a"), F.lit(0.0))).collect()} == {-200.0}


@pytest.mark.parametrize("few,cells", [(1, 4), (10, 4096), (1 << 15, 4096)])
def test_quantiles_of_many_series(spark, monkeypatch, few, cells):
    monkeypatch.setattr(quantiles, "CELLS", cells)
    monkeypatch.setattr(quantiles, "PASSES", 60)
    rng = np.random.default_rng(few)
    series = {
        "normal": rng.normal(size=301), "wide": rng.normal(size=200) * 10.0 ** rng.integers(-300, 300, 200), "ties": rng.integers(0, 3, 100) * 1.0,
        "one": [4.0], "tiny": rng.integers(0, 9, 50) * 5e-324, "near": 1 + rng.integers(0, 5, 40) * 2.0**-52, "zero": [0.0, -0.0, 0.0],
    }
    rows = [(s, float(x)) for s, v in series.items() for x in v] + [("normal", None), ("normal", float("nan")), ("empty", None), (None, 3.0)]
    shares = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {(r.by, r.share): r.value for r in quantiles.grouped_quantiles(spark.createDataFrame(rows, "s string, x double"), "s", "x", shares, few).collect()}
    want = {(s, p): np.quantile(v, p) for s, v in (*series.items(), (None, [3.0])) for p in shares}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12, abs=0) for k in want)
