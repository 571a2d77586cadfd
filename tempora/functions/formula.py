"""Formulas over series, compiled to columns: + - * / ^, unary signs and a few functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import NAN, safe_div, safe_div_once, safe_ln

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|`([^`]+)`|([A-Za-z_][A-Za-z0-9_.\[\]]*)|([-+*/^(),]))")


def root(v: Column, d: Column) -> Column:
    """The d-th root; odd ones of negative values are negative, and near-integers are rounded."""
    odd = (d == F.floor(d)) & (F.abs(d % 2) == 1)
    r = F.when(d == 0, F.lit(NAN)).when((v < 0) & odd, -F.pow(F.abs(v), safe_div(F.lit(1.0), d))).otherwise(F.pow(v, safe_div(F.lit(1.0), d)))
    return F.when(F.abs(r - F.rint(r)) <= 1e-12 * F.greatest(F.lit(1.0), F.abs(r)), F.rint(r)).otherwise(r)


FUNCTIONS = {
    "sqrt": (1, F.sqrt), "abs": (1, F.abs), "log": (1, safe_ln), "ln": (1, safe_ln), "log10": (1, lambda x: safe_ln(x) / F.ln(F.lit(10.0))),
    "power": (2, F.pow), "pow": (2, F.pow), "root": (2, root), "square": (1, lambda x: x * x), "sqr": (1, lambda x: x * x),
}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"formula: unexpected {text[at:].strip()[0]!r}")
        kind = "number" if m[1] else "name" if m[2] or m[3] else "sign"
        out.append((kind, m[1] or m[2] or m[3] or m[4]))
        at = m.end()
    return out


#: Brackets in each other at most.
DEEPEST = 100


class _Reader:
    def __init__(self, text: str, names: dict[str, Column]):
        self.left, self.names, self.depth = tokens(text), names, 0
        self.div = safe_div_once if text.count("/") > 1 else safe_div

    def take(self, *signs: str) -> str | None:
        if self.left and self.left[0][0] == "sign" and self.left[0][1] in signs:
            return self.left.pop(0)[1]
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise ValueError(f"formula: {sign!r} is missing")

    def total(self) -> Column:
        out = self.product()
        while s := self.take("+", "-"):
            out = out + self.product() if s == "+" else out - self.product()
        return out

    def product(self) -> Column:
        out = self.signed()
        while s := self.take("*", "/"):
            out = out * self.signed() if s == "*" else self.div(out, self.signed())
        return out

    def signed(self) -> Column:
        if s := self.take("+", "-"):
            return -self.signed() if s == "-" else self.signed()
        base = self.atom()
        return F.pow(base, self.signed()) if self.take("^") else base

    def atom(self) -> Column:
        if self.take("("):
            self.depth += 1
            if self.depth > DEEPEST:
                raise ValueError(f"formula: more than {DEEPEST} brackets in each other")
            out = self.total()
            self.need(")")
            self.depth -= 1
            return out
        if not self.left or self.left[0][0] == "sign":
            raise ValueError("formula: a value is missing")
        kind, v = self.left.pop(0)
        if kind == "number":
            return F.lit(float(v))
        if v.lower() in FUNCTIONS and self.take("("):
            n, f = FUNCTIONS[v.lower()]
            args = [self.total()]
            while self.take(","):
                args.append(self.total())
            self.need(")")
            if len(args) != n:
                raise ValueError(f"formula: {v} takes {n} values")
            return f(*args)
        if v not in self.names:
            raise ValueError(f"formula: unknown name {v!r}")
        return self.names[v]


def compile_formula(text: str, names: dict[str, Column]) -> Column:
    """The column that ``text`` says, of series given by name."""
    r = _Reader(text, names)
    out = r.total()
    if r.left:
        raise ValueError(f"formula: unexpected {r.left[0][1]!r}")
    return out
