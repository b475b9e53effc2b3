"""Compare a query's rows with its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else repr(v)) if math.isfinite(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v.asDict().values())
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    return v


def same(df, sql: str, sf_dir: str) -> tuple[bool, str]:
    con = connect(sf_dir)
    own = con.execute(sql)
    names = [d[0] for d in own.description]
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} and {sorted(names)}"
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in own.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    if len(want) != len(got):
        return False, f"{len(got)} rows and {len(want)} in SQL"
    odd = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return not odd, f"{len(odd)} of {len(got)} rows differ: {odd[:3]}"
