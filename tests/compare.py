"""Compares a registered query with its oracle SQL on one folder of test tables."""

from __future__ import annotations

import math
import os

import duckdb

DATA = os.environ.get("TEMPORA_TESTDATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return names, got.fetchall()


def _key(v) -> str:
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    return str(v)


def differences(names_a, rows_a, names_b, rows_b) -> list[str]:
    """What differs between two results, with columns by name and rows in any order."""
    if sorted(names_a) != sorted(names_b):
        return [f"columns {sorted(names_a)} and {sorted(names_b)}"]
    order_a, order_b = ([n.index(c) for c in sorted(names_a)] for n in (names_a, names_b))
    a = sorted(tuple(_key(r[i]) for i in order_a) for r in rows_a)
    b = sorted(tuple(_key(r[i]) for i in order_b) for r in rows_b)
    if len(a) != len(b):
        return [f"{len(a)} and {len(b)} rows"]
    return [f"{x} and {y}" for x, y in zip(a, b, strict=True) if x != y and not _close(x, y)][:5]


def _close(x: tuple, y: tuple) -> bool:
    for u, v in zip(x, y, strict=True):
        if u != v:
            try:
                if not math.isclose(float(u), float(v), rel_tol=1e-7, abs_tol=1e-9):
                    return False
            except ValueError:
                return False
    return True


def check(spark, name: str, query, sql: str, sf_dir: str) -> list[str]:
    df = query(spark, sf_dir)
    names, rows = oracle(sf_dir, sql)
    return differences(df.columns, [tuple(r) for r in df.collect()], names, rows)
