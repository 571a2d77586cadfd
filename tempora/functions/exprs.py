"""Guarded column expressions: one class of missing values, floats as IEEE has them, UTC time in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")
HOUR, DAY, WEEK = 3_600_000, 86_400_000, 604_800_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """Neither null, NaN nor infinite."""
    c = col(c).cast("double")
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != INF), F.lit(False))


def clean(c: Column | str) -> Column:
    return F.when(finite(c), col(c).cast("double"))


def safe_div(a: Column, b: Column) -> Column:
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(F.signum(a) * INF)
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def safe_div_once(a: Column, b: Column) -> Column:
    """``safe_div`` that computes its arguments once, so that plans of nested divisions stay in proportion to their text."""
    both = F.array(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
    return F.element_at(F.transform(both, lambda x: safe_div(x["a"], x["b"])), 1)


def safe_ln(x: Column) -> Column:
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.ln(x))


def epoch_ms(c: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, in a session whose zone is UTC."""
    return F.unix_millis(col(c).cast("timestamp"))


def at_ms(ms: int) -> Column:
    """The timestamp without zone of a number of milliseconds, as a literal that scans can push down."""
    from datetime import datetime, timedelta

    return F.lit((datetime(1970, 1, 1) + timedelta(milliseconds=int(ms))).isoformat(sep=" ")).cast("timestamp_ntz")


def between_ms(c: str, lo: int, hi: int) -> Column:
    """lo <= floor(ms) <= hi on the native column; bounds may come in either order."""
    lo, hi = min(lo, hi), max(lo, hi)
    return (F.col(c) >= at_ms(lo)) & (F.col(c) < at_ms(hi + 1))


def bucket(t: Column, lo: float, span: float, n: int) -> Column:
    """Which of ``n`` equal parts of [lo, lo + span] a value is in; the last one is closed."""
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((t - lo) * n / F.lit(float(span))))).cast("long")


def day_start(t: Column) -> Column:
    return t - F.pmod(t, F.lit(DAY))


def weekday(t: Column) -> Column:
    """0 for Monday."""
    return F.pmod(F.floor(t / DAY) + 3, F.lit(7)).cast("long")


def week_start(t: Column) -> Column:
    return day_start(t) - weekday(t) * DAY
