"""Rows of a DataFrame and of a DuckDB query, made comparable."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _value(x):
    if x is None or type(x).__name__ in ("NAType", "NaTType") or x != x:
        return "null"
    if isinstance(x, bool) or type(x).__name__ == "bool_" or type(x).__name__ == "bool":
        return str(bool(x))
    try:
        f = float(x)
    except (TypeError, ValueError):
        return str(x)
    return f"{f:.6f}" if math.isfinite(f) else str(f)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(_value, r)) for r in frame.itertuples(index=False))
