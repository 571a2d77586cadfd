"""Numbers in text, as a rule for single cells of a sample and as the same rule in columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def number(cell: str, comma: bool = False) -> float | None:
    """A cell's number: inner white space goes, D may stand for an exponent, a comma for the decimal point; None if it is none."""
    s = re.sub(r"\s+", "", cell)
    if comma and "." not in s:
        s = s.replace(",", ".", 1)
    s = re.sub(r"(?<=[\d.])[dD](?=[+-]?\d)", "E", s)
    if re.fullmatch(r"[+-]?inf(inity)?", s, re.I):
        return float(s)
    if s.lower() == "nan":
        return float("nan")
    return float(s) if re.fullmatch(_NUMBER, s) else None


def number_of(c: Column, comma: bool = False) -> Column:
    """``number`` as a column; null where the text is no number."""
    # most cells are plain numbers, which a cast reads; it would also take 1d, 1f and 0x1p1
    plain = F.translate(c, "0123456789.+-eE", "") == ""
    # what others may be is kept out of generated code, which it would outgrow
    return F.when(plain, c.try_cast("double")).otherwise(F.element_at(F.transform(F.array(c), lambda x: _unlike(x, comma)), 1))


def _unlike(c: Column, comma: bool) -> Column:
    s = F.regexp_replace(c, r"\s+", "")
    if comma:
        s = F.when(F.contains(s, F.lit(".")), s).otherwise(F.regexp_replace(s, ",", "."))
    s = F.regexp_replace(s, r"(?<=[\d.])[dD](?=[+-]?\d)", "E")
    named = F.when(F.lower(s).isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf"))).when(F.lower(s).isin("-inf", "-infinity"), F.lit(float("-inf"))).when(F.lower(s) == "nan", F.lit(float("nan")))
    return F.when(s.rlike(f"^{_NUMBER}$"), s.try_cast("double")).otherwise(named)
