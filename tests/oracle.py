"""Compare a registered query with its DuckDB oracle, whatever the order of rows and columns."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr), [names[i] for i in order]


def differences(spark, run, sql: str, sf_dir: str) -> str:
    df = run(spark, sf_dir)
    got, names = rows(df.columns, [tuple(r) for r in df.collect()])
    res = connect(sf_dir).execute(sql)
    want, wanted = rows([c[0] for c in res.description], res.fetchall())
    if names != wanted:
        return f"columns {names} and {wanted}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; first only here {[x for x in got if x not in set(want)][:2]}, there {[x for x in want if x not in set(got)][:2]}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{a} and {b}"
    return "" if got else "no rows"
