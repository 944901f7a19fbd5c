"""Hold a query against DuckDB: row counts, column names and values, in any order."""

from __future__ import annotations

import decimal
import math
import os
import pathlib

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(canon(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(canon(x) for x in v.values())
    if hasattr(v, "tolist"):
        return canon(v.tolist())
    return v


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = pathlib.Path(sf_dir, f"{t}.parquet")
        if p.exists():
            at = str(p) if p.is_file() else f"{p}/*.parquet"
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}')")
    rel = con.sql(sql)
    names = list(rel.columns)
    return names, con.execute(sql).fetchall()


def compare(df, sql: str, sf_dir: str) -> str:
    names, want = oracle_rows(sql, sf_dir)
    got = df.collect()
    have = df.columns
    if sorted(names) != sorted(have):
        return f"columns {sorted(have)} against {sorted(names)}"
    order = sorted(names)
    a = sorted((tuple(canon(r[c]) for c in order) for r in got), key=repr)
    b = sorted((tuple(canon(r[names.index(c)]) for c in order) for r in want), key=repr)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    for x, y in zip(a, b, strict=True):
        if x != y and not all(p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and math.isclose(p, q, rel_tol=1e-7, abs_tol=1e-9)) for p, q in zip(x, y, strict=True)):
            return f"{order}: {x} against {y}"
    return ""


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
